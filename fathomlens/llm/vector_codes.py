"""Operator 11: compression of vectors to one code for each part, by integer codebooks and value dictionaries.

Components become integers, and vectors are stored in blocks: for each dimension the block's distinct integers, sorted, and for each
vector the number of its integer in that dictionary. To compare a block with a codebook, the squared differences of every distinct integer
to all entries are tabulated once a dimension; the distances of all parts are then gathers from these tables by the
dictionary codes, added up over the dimensions of a part. Each round is one pass over the blocks; a task gives back one
sum for each entry, and Spark adds these up, so the driver gets one codebook's numbers, whatever the number of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, dealt, table, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors in a block, at most; integers in a block, about.
BLOCK, BLOCK_INTEGERS = 4096, 1 << 20
#: Integers are held within so far of zero, for which distances and sums stay exact in 64 bits.
FAR = 1 << 26

_BLOCKS = "size int, ids array<long>, nulls array<boolean>, labels array<string>, bounds binary, values binary, codes binary"
_SUMS = "size int, part int, entry int, n long, sums array<long>"


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor a component that is not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _integers(vector: Column, scale: int) -> Column:
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-FAR))), F.lit(float(FAR)))).cast("long")
    return F.transform(vector, whole)


def cuts(size: int, parts: int) -> list[int]:
    """Where the parts of vectors of `size` components begin, and the end: equal parts, or as equal as can be, the longer ones first."""
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(size), parts)]).tolist()]


def _pack(size: int, ids: list, labels: list, rows: np.ndarray) -> pa.RecordBatch:
    """A block of vectors as dictionaries and codes, dimension by dimension."""
    bounds, values, codes = [0], [], []
    for d in range(size):
        distinct, place = np.unique(rows[:, d], return_inverse=True)
        bounds.append(bounds[-1] + len(distinct))
        values.append(distinct.astype(np.int32))
        codes.append(place.astype(np.uint16))
    data = lambda x, t: np.concatenate(x).astype(t).tobytes() if x else b""
    columns = {
        "size": pa.array([size], pa.int32()),
        "ids": pa.array([[0 if i is None else i for i in ids]], pa.list_(pa.int64())),
        "nulls": pa.array([[i is None for i in ids]], pa.list_(pa.bool_())),
        "labels": pa.array([labels], pa.list_(pa.string())),
        "bounds": pa.array([np.array(bounds, np.int32).tobytes()], pa.binary()),
        "values": pa.array([data(values, np.int32)], pa.binary()),
        "codes": pa.array([data(codes, np.uint16)], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        for size in np.unique(sizes):
            chosen = np.flatnonzero(sizes == size)
            step = max(1, min(BLOCK, BLOCK_INTEGERS // max(1, int(size))))
            for at in range(0, len(chosen), step):
                rows = batch.take(pa.array(chosen[at : at + step]))
                flat = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, int(size))
                yield _pack(int(size), rows.column(0).to_pylist(), rows.column(1).to_pylist(), flat)


class Codebook:
    """The entries of each part for vectors of one size: at[p] and at[p + 1] bound the dimensions of part p."""

    def __init__(self, entries: np.ndarray, parts: int):
        self.at = cuts(entries.shape[1], parts)
        self.parts = [entries[:, a:b].copy() for a, b in zip(self.at, self.at[1:])]  # noqa: B905

    def assign(self, bounds: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, its squared distance) for each part and vector of a block; the lower entry of equals."""
        n = codes.shape[1]
        nearest, errors = np.zeros((len(self.parts), n), np.int64), np.zeros((len(self.parts), n), np.int64)
        for p, (entries, a) in enumerate(zip(self.parts, self.at, strict=False)):
            distance = np.zeros((n, len(entries)), np.int64)
            for i in range(entries.shape[1]):
                table = values[bounds[a + i] : bounds[a + i + 1], None] - entries[:, i]
                distance += (table * table)[codes[a + i]]
            nearest[p] = distance.argmin(1)
            errors[p] = distance[np.arange(n), nearest[p]]
        return nearest, errors

    def sums(self, p: int, entry: np.ndarray, bounds: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The sums of part p over the vectors of each entry."""
        entries, out = self.parts[p], np.zeros(self.parts[p].shape, np.int64)
        order = np.argsort(entry, kind="stable")
        used, starts = np.unique(entry[order], return_index=True)
        for i in range(entries.shape[1]):
            d = self.at[p] + i
            out[used, i] = np.add.reduceat(values[bounds[d] : bounds[d + 1]][codes[d]][order], starts)
        return out


def _open(batch: pa.RecordBatch, row: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    size = batch.column("size")[row].as_py()
    read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
    count = len(batch.column("ids")[row])
    return size, read("bounds", np.int32), read("values", np.int32).astype(np.int64), read("codes", np.uint16).reshape(size, count)


def _round(blocks: DataFrame, books: dict[int, Codebook]) -> dict[int, Codebook]:
    """The codebooks after one round over all blocks; entries that no part is nearest to stay."""

    def run(batches):
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                size, *block = _open(batch, row)
                book = books[size]
                nearest, _ = book.assign(*block)
                for p, entry in enumerate(nearest):
                    n, sums = np.bincount(entry, minlength=len(book.parts[p])), book.sums(p, entry, *block)
                    before = total.get((size, p), (0, 0))
                    total[size, p] = before[0] + n, before[1] + sums
        rows = [(size, p, e, int(n[e]), sums[e]) for (size, p), (n, sums) in total.items() for e in np.flatnonzero(n)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["size", "part", "entry", "n", "sums"])

    partial = blocks.select("size", "ids", "bounds", "values", "codes").mapInArrow(tidy(run), _SUMS)
    sums = partial.select("size", "part", "entry", "n", F.posexplode_outer("sums").alias("place", "x")).groupBy("size", "part", "entry", "place")
    for r in sums.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # one number for each of the codebooks' numbers
        if r.place is not None:
            books[r["size"]].parts[r.part][r.entry, r.place] = r.x // r.n
    return books


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, Codebook]]:
    """(rows, codebooks by vector size): rows with vec_id, label, size, codes (an array, one for each part) and error.

    Vectors that are null or hold a null or a component that is not finite are left out. `entries` vectors with the smallest ids (of repeated ids, the
    least vector by its components; those without an id last) start the codebook; fewer vectors make a smaller one. Vectors of each size have a
    codebook of their own, and sizes that `parts` doesn't divide have longer parts first. Components beyond FAR / `scale` count as that. Repeated rows stay.
    The driver holds the codebooks: `entries` vectors for each size that occurs."""
    kept = vectors.where(usable(F.col(f"`{vector}`"))).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), _integers(F.col(f"`{vector}`"), scale).alias("v"))
    kind = kept.schema["label"].dataType
    rows = kept.select("id", F.col("label").cast("string").alias("label"), "v")
    blocks = cut(rows.mapInArrow(tidy(_blocks), _BLOCKS))
    books = {}
    for size in sorted(r["size"] for r in blocks.select("size").distinct().collect()):
        first = kept.where(F.size("v") == size).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        books[size] = Codebook(np.array([r.v for r in first], np.int64).reshape(len(first), size), parts)
    for _ in range(rounds):
        books = _round(blocks, books)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                size, *block = _open(batch, row)
                nearest, errors = books[size].assign(*block)
                ids = pa.array(batch.column("ids")[row].values.to_numpy(), pa.int64(), mask=np.array(batch.column("nulls")[row].as_py(), bool))
                stops = pa.array(np.arange(len(ids) + 1) * parts, pa.int32())
                codes = pa.ListArray.from_arrays(stops, pa.array(nearest.T.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, batch.column("labels")[row].values, pa.array(np.full(len(ids), size), pa.int32()), codes, pa.array(errors.sum(0))], ["vec_id", "label", "size", "codes", "error"])

    coded = blocks.mapInArrow(tidy(run), "vec_id long, label string, size int, codes array<int>, error long")
    return coded.withColumn("label", F.col("label").cast(kind)), books


def label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with label_error: its error summed over all rows of the same label, nulls together; null where a sum passes 64 bits."""
    coded = cut(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    sums = cut(coded.groupBy("key").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error")))
    left, right = dealt(coded, sums, "key", "n", F.struct("vec_id", "codes"))
    return left.join(right.drop("n"), ["key", "deal"]).drop("key", "deal")


def digest(books: dict[int, Codebook]) -> str:
    """The hash of all entries' components, by size, part, entry and place."""
    return hashlib.sha256(",".join(str(x) for size in sorted(books) for part in books[size].parts for x in part.ravel().tolist()).encode()).hexdigest()


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB SQL for the rows of op11: the rounds written out, one after another."""
    assign = """a{0} AS MATERIALIZED (
    SELECT row, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS best FROM (
        SELECT p.row, p.part, p.x, c.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) AS d FROM p JOIN c{0} c ON c.part = p.part
    ) GROUP BY row, part
)"""
    update = """c{1} AS MATERIALIZED (
    SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{0} c LEFT JOIN (
        SELECT part, entry, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS x FROM (
            SELECT part, best.entry AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{0}, range(1, 1000) r(i) WHERE i <= len(x) GROUP BY ALL
        ) GROUP BY ALL
    ) n ON n.part = c.part AND n.entry = c.entry
)"""
    steps = [x for r in range(ROUNDS) for x in (assign.format(r), update.format(r, r + 1))] + [assign.format(ROUNDS)]
    return f"""WITH v AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT row, CAST(part AS INTEGER) AS part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM v, range({PARTS}) q(part)
), c0 AS MATERIALIZED (
    SELECT part, row - 1 AS entry, x FROM p WHERE row <= {ENTRIES}
), {", ".join(steps)}, e AS (
    SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row
), b AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e ON e.row = v.row, b"""


ORACLE = _oracle()
