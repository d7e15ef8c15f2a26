"""Operator 4: near-duplicate documents by MinHash bands and odd sketches.

A document is the set of its distinct k-word shingles. One hash of each shingle
fills a one-permutation MinHash of SLOTS samples (empty slots borrow by a fixed
random probe order). Every second sample goes into BANDS bands of ROWS samples; all
samples are folded into an odd sketch, a bitmap in which sample (slot, value)
flips one bit, so that the XOR of two sketches counts the samples in which two
documents differ:

    differing = -bits / 2 * ln(1 - 2 * ones / bits),  similarity = 1 - differing / (2 * SLOTS)

1. Documents with the same set form a class; classes are compared, copies are not.
2. In every bucket (band value) each class is paired with the smallest one: as many
   pairs as rows, however large the bucket. Pairs that the sketches estimate at less than
   the threshold minus MARGIN go; the rest are compared on their full sets.
3. Buckets that still hold classes of different components are compared all against
   all by sketch in blocks of bounded size, but only across components, and what
   the sketches keep is again compared on full sets.

Both rounds end in one connected-components run. A pair at the threshold shares no
band with a probability of MISS at most; the estimate's standard error there is 0.011, a quarter
of MARGIN, and less for small sets, which the samples cover.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, cut, key_runs, long_lists, mix, shingles, table, text_slices, tidy, word_hashes

SLOTS, BANDED, MISS = 2048, 256, 1e-4
BITS = 4096
MARGIN = 0.04
BLOCK = 1024
_TRIES = 16
_EDGES = (np.arange(SLOTS, dtype=np.uint64) << np.uint64(53)).astype(np.uint64)
_SLOT_KEY = mix(np.arange(SLOTS, dtype=np.uint64) + np.uint64(977))
_ROW_KEY = mix(np.arange(SLOTS, dtype=np.uint64) + np.uint64(31)) | np.uint64(1)
_BAND_KEY = mix(np.arange(SLOTS, dtype=np.uint64) + np.uint64(7919))


def band_rows(similarity: float) -> int:
    """The longest bands of BANDED samples that a pair of this similarity misses with a probability of MISS at most."""
    miss = lambda rows: (1 - similarity**rows) ** (BANDED // rows)
    return max(rows for rows in range(1, 33) if rows == 1 or miss(rows) <= MISS)


@functools.cache
def _probes() -> tuple[np.ndarray, np.ndarray]:
    """For each slot, the order in which it asks the others for a sample: its first _TRIES, and the place of each."""
    draw = np.random.default_rng(4)
    first, place = np.empty((SLOTS, _TRIES), np.int64), np.empty((SLOTS, SLOTS), np.uint16)
    for at in range(0, SLOTS, 64):  # few rows at a time: whole, the ranks would be held three times in 8 bytes
        order = draw.random((min(64, SLOTS - at), SLOTS)).argsort(1)
        first[at : at + 64], place[at : at + 64] = order[:, :_TRIES], order.argsort(1)
    return first, place


def minhash(shingle_set: np.ndarray) -> np.ndarray:
    """SLOTS samples of a sorted, not empty set: the least hash of each of as many parts of the hash range."""
    at = np.searchsorted(shingle_set, _EDGES)
    full = np.append(at[1:], len(shingle_set)) > at
    out = shingle_set[np.minimum(at, len(shingle_set) - 1)]
    if not full.all():
        first, place = _probes()
        empty, filled = np.flatnonzero(~full), np.flatnonzero(full)
        if len(filled) > _TRIES:
            tried = full[first[empty]]
            donor = first[empty, tried.argmax(1)]
            lost = np.flatnonzero(~tried.any(1))
        else:
            donor, lost = np.empty_like(empty), np.arange(len(empty))
        if len(lost):  # the same rule, over all full slots
            donor[lost] = filled[place[np.ix_(empty[lost], filled)].argmin(1)]
        out[empty] = out[donor]
    return out


def signature(shingle_set: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band values, odd sketch as BITS / 64 words) of a sorted, not empty set, for bands of `rows` samples."""
    samples = minhash(shingle_set)
    count = BANDED // rows
    bands = mix((mix(samples[:: SLOTS // BANDED][: count * rows]).reshape(count, rows) * _ROW_KEY[:rows]).sum(1, dtype=np.uint64) ^ _BAND_KEY[:count])
    bit = mix(samples ^ _SLOT_KEY) % np.uint64(BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=BITS) & 1
    return bands.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


def estimate(ones):
    """Similarity for a count of differing sketch bits (numpy)."""
    return 1 + BITS / (4 * SLOTS) * np.log(np.maximum(1 - 2 * np.asarray(ones) / BITS, 1e-9))


def _sets(k: int, rows: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (id, text): with `rows`, signatures for bands of so many samples, without, the full sets."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in text_slices(texts):
                hashes, bounds = word_hashes(texts.slice(lo, hi - lo))
                sets = [shingles(hashes[a:b], k) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                if not rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), sizes, _lists([s.view(np.int64) for s in sets])], ["id", "size", "shingles"])
                    continue
                signed = [signature(s, rows) if len(s) else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for s in sets]
                digest = [(mix(s).sum(dtype=np.uint64), mix(s ^ _SLOT_KEY[0]).sum(dtype=np.uint64)) for s in sets]
                keys = pa.array([f"{len(s):x}-{int(x):016x}{int(y):016x}" for s, (x, y) in zip(sets, digest, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), sizes, keys, _lists([b for b, _ in signed]), _lists([s for _, s in signed])],
                    ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
                )

    return run


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _in_buckets(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of classes of two components whose sketches agree, of the rows of two blocks of a bucket."""

    def run(batches):
        for rows in key_runs(batches, 3):
            i, j, side, rep, comp = (rows.column(k).to_numpy() for k in range(1, 6))
            sketch = long_lists(rows.column(6)).view(np.uint64)
            left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if i[0] != j[0] else (np.arange(len(rep)),) * 2
            a, b = [], []
            for at in range(0, len(left), 64):
                part = left[at : at + 64]
                ones = np.bitwise_count(sketch[part, None] ^ sketch[None, right]).sum(2, dtype=np.int64)
                x, y = np.nonzero((estimate(ones) >= least) & (comp[part, None] != comp[None, right]))
                a.append(rep[part[x]])
                b.append(rep[right[y]])
            if a and sum(map(len, a)):
                a, b = np.concatenate(a), np.concatenate(b)
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Two documents are linked where 100 * |A and B| >= percent * |A or B| on full
    shingle sets. component_id is the smallest id reachable by links. Null and empty
    texts have no shingles and link with nothing; a text of fewer than k words is one
    shingle. A row without an id is never linked and is kept, with a null component.
    Rows that repeat an id are judged by their own text. Other columns of
    `docs` are not looked at. No rows give no rows."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(docs.mapInArrow(tidy(_sets(k, band_rows(percent / 100))), "doc_id long, n_shingles long, set_key string, bands array<long>, sketch array<long>"))
    able = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(able.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))

    # Round 1: every class of a bucket against the bucket's smallest.
    rows = classes.select(F.explode("bands").alias("bucket"), "rep")
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket", "low")
    members = cut(rows.join(shared, "bucket"))
    pairs = members.where("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    sketches = classes.select("rep", "sketch")
    one, two = sketches.toDF("a", "sa"), sketches.toDF("b", "sb")
    ones = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = F.lit(1.0) + F.lit(BITS / (4 * SLOTS)) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * ones / BITS)) >= percent / 100 - MARGIN
    pairs = cut(pairs.join(one, "a").join(two, "b").where(close).select("a", "b"))
    first = cut(verified(docs, pairs, k, percent))

    # Round 2: what is left between components inside a bucket.
    comp = components(first).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    placed = members.select("bucket", "rep").distinct().join(comp, "rep", "left").select("bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
    placed = cut(placed)
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocked = placed.join(mixed, "bucket").join(sketches, "rep").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int"))
    other = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sided = other.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "comp", "sketch"
    )
    together = sided.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = together.mapInArrow(tidy(_in_buckets(percent / 100 - MARGIN)), "a long, b long").distinct()
    second = verified(docs, cut(more.join(pairs, ["a", "b"], "left_anti")), k, percent)

    found = components(first.union(second)).toDF("rep", "component_id")
    named = classes.select("set_key", "rep").join(found, "rep", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
        .join(named, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach `percent`; sets are made of the needed texts only."""
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.join(need.hint("merge"), "doc_id", "left_semi")  # one plan at every size; ids are never broadcast
    sets = cut(texts.mapInArrow(tidy(_sets(k)), "id long, size long, shingles array<long>"))
    a, b = sets.toDF("a", "na", "wa"), sets.toDF("b", "nb", "wb")
    # |A and B| >= p / (100 + p) * (|A| + |B|) is the same as 100 |A and B| >= p |A or B|
    both = F.size(F.array_intersect("wa", "wb"))
    return pairs.join(a, "a").join(b, "b").where((100 + percent) * both >= percent * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
