"""What several operators of this subpackage share: cut lineage, connected
components, splitting rows by a stable hash, and word hashes over Arrow buffers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and read again from a table in the folder of ``spark.checkpoint.dir``.

    Later work neither repeats it nor loses it with an executor, and plans start anew, which
    a checkpoint's don't: it hands on the constraints of the plan that made it, and in
    loops those grow without end. Only where no folder is configured and all runs on one machine (tests) does this set
    one of its own; on a cluster a missing folder is an error. The tables stay, like checkpoints, until the folder is cleared."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _libc():
    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:  # another C library has no such call
        return None


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow or mapInPandas, giving back to the system at the task's end what the worker has freed.

    Workers serve many tasks, of later operators too, and would otherwise keep the most that any of them had in use."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if _libc():
                _libc().malloc_trim(0)

    return tidied


#: A key with more than one HOT-th of all rows is dealt over several partitions.
HOT = 4096


def dealt(rows: DataFrame, keys: DataFrame, key: str, n: str, by: Column) -> tuple[DataFrame, DataFrame]:
    """`rows` and `keys` with a column `deal` more, to be joined on `key` and `deal`: the rows of a frequent key are dealt
    out by a hash of `by`, and its row in `keys`, which has the number `n` of its rows, is there once for each share.

    At most HOT keys are frequent, which bounds what is broadcast to find their rows; a share is at most two HOT-ths of all rows."""
    total = keys.agg(F.sum(n)).first()[0] or 0
    shares = F.ceil(F.col(n) * HOT / F.lit(max(total, 1))).cast("int")
    frequent = keys.where(F.col(n) * HOT > total).select(F.col(key).alias("frequent key"), shares.alias("shares"))
    rows = rows.join(F.broadcast(frequent), F.col(key).eqNullSafe(F.col("frequent key")), "left")
    rows = rows.withColumn("deal", F.pmod(F.xxhash64(by), F.coalesce("shares", F.lit(1))).cast("int")).drop("frequent key", "shares")
    return rows, keys.withColumn("deal", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn a label from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph `edges` (a long, b long).

    Returns (node, component): each node that has an edge, with the smallest node
    that it reaches. Each level sends every node to the neighbour (or itself) that
    has the smallest random rank of that level and contracts the graph, so also a
    long chain shrinks by a constant share a level. Minima are taken by partial
    aggregation, so a node with very many neighbours is no hot task. Null ends
    and loops are ignored."""
    level = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    steps: list[DataFrame] = []
    while not level.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("r"), F.col(c).alias("id"))  # noqa: E731, B023
        both = level.select(F.col("a").alias("node"), F.least(rank("a"), rank("b")).alias("low")).union(
            level.select("b", F.least(rank("a"), rank("b")))
        )
        step = cut(both.groupBy("node").agg(F.min("low").alias("low")).select("node", F.col("low.id").alias("root")))
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        level = cut(
            level.join(left, "a")
            .join(right, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if not steps:
        return level.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps.pop()
    while steps:  # from the last level back, so that every join is as small as its level
        up = found.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = cut(steps.pop().join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
    least = found.groupBy("root").agg(F.min("node").alias("low"))
    return found.join(least, "root").select("node", F.col("low").alias("component"))


# ---------------------------------------------------------------- word hashes

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z; all other bytes as they are
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators where only letters and digits make words: all other ASCII characters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about `most` bytes each."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, min(to, len(column))
        at = min(to, len(column))


def _hash_run(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in `data`, which neither starts nor ends inside a word."""
    word = ~space[data]
    edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    length = ends - starts
    powers = np.full(int(length.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _BYTE[data] * powers[np.minimum(place, len(powers) - 1)]
    value[~word] = 0
    return starts, mix(np.add.reduceat(value, starts) + length.astype(np.uint64))


def word_hashes(column: pa.Array, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, row bounds into them) of a string column.

    Words are runs of bytes other than ASCII white space (or than those marked in `space`), A-Z as a-z. A null text
    has no words. Work memory is bounded by SLICE, whatever the length of a text."""
    column = column.cast(pa.large_string())
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    hashes, counts = [], np.zeros(n, np.int64)
    for lo, hi in text_slices(column):
        a, z = int(ends[lo]), int(ends[hi])
        while a < z:
            b = z
            if z - a > 2 * SLICE:  # one long text: cut it after white space
                gaps = np.flatnonzero(space[data[a + SLICE : min(z, a + 9 * SLICE)]])
                b = a + SLICE + int(gaps[0]) + 1 if len(gaps) else z
            run = data[a:b]
            inner = ends[lo + 1 : hi] - a
            inner = inner[(inner > 0) & (inner < b - a)]
            if len(inner):  # a gap at every row's end keeps words of two rows apart
                run = np.insert(run, inner, 32)
            starts, found = _hash_run(run, space)
            row_starts = np.clip(ends[lo : hi + 1] - a, 0, b - a)
            row_starts = row_starts + np.searchsorted(inner, row_starts, "left")
            row_starts[0] = 0
            counts[lo:hi] += np.diff(np.append(np.searchsorted(starts, row_starts[:-1]), len(starts)))
            hashes.append(found)
            a = b
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts)))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of `k` neighbouring words, sorted; of fewer words, of the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix(np.array([(words * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = words[: n - k + 1] * _PLACE[0]
    for i in range(1, k):
        out = out + words[i : n - k + 1 + i] * _PLACE[i]
    return np.unique(mix(out))


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first `keys` columns (integers, not null), over batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        at = np.concatenate(([0], np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1, [batch.num_rows]))
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            now = tuple(columns[:, lo])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(lo), int(hi - lo)))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def long_lists(column: pa.ChunkedArray, dtype=np.int64) -> np.ndarray:
    """A column of lists of one length, as rows of a matrix."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(dtype, copy=False).reshape(len(column), -1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
