"""Operator 5: near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook of K words (k-means on
a bounded sample), and the product of both is a grid of K * K cells in which every vector is
filed. A query visits cells in the order of the sum of its squared distances to their two
words (the multi-sequence order). How many cells it visits is measured: brute force over a sample of queries
against all rows gives the rank of the cell of every true partner, and the
visits are the least number at which the mean recall of the queries that have partners reaches TARGET. Samples
grow until ENOUGH queries have partners. Where even the largest has fewer, partners are made: at the least cosine, the hardest to find, in random
directions. So the visits follow from the data and the threshold alone, and never become all cells because partners are rare.

Visits and filed vectors meet by cell, in blocks of bounded size, so a cell with a third of all
vectors is spread over many tasks. A task returns counts of links and, instead of all
linked pairs, a spanning forest of them. A pair that would be seen from both sides is
counted from one, which both tasks can tell from the visits that travel with a row."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import components, cut, key_runs, long_lists, table, tidy

#: Bound of the sample that codebooks are fitted on, sizes of the samples of queries that recall is measured with, and
#: how many queries with partners are enough.
TRAIN, PROBES, ENOUGH = 16_384, (256, 2048, 16_384), 100
TARGET = 0.995
#: Queries whose id is divisible by UNSEEN measure the recall, a bounded sample of them as of the others; how many partners are made.
UNSEEN, LEAST_RECALL, MADE = 20, 0.9, 2048
CELL = 16
BLOCK = 2048
_SLACK = 1e-12


def kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    words = rows[rng.choice(len(rows), k, replace=len(rows) < k)]
    for _ in range(rounds):
        near = distances(rows, words).argmin(1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, rows)
        sizes = np.bincount(near, minlength=k)
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], rows[rng.integers(0, len(rows), k)])
    return words


def distances(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] - 2 * rows @ words.T + (words**2).sum(1)


class MultiIndex:
    """Two codebooks over the halves of unit vectors."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.one, self.two = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k, seed=6)
        self.k = k

    def sides(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(rows[:, : self.half], self.one), distances(rows[:, self.half :], self.two)

    def cell(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.sides(rows)
        return a.argmin(1) * self.k + b.argmin(1)

    def visits(self, rows: np.ndarray, count: int) -> np.ndarray:
        """The `count` first cells of each row in multi-sequence order.

        Cell (i, j) of the sorted distances comes after all (i', j') with i' <= i and j' <= j, so only those
        with (i + 1) * (j + 1) <= count can be among them."""
        count = min(count, self.k * self.k)
        i, j = np.array([(x, y) for x in range(min(count, self.k)) for y in range(min(self.k, count // (x + 1)))]).T
        a, b = self.sides(rows)
        near_a, near_b = np.argsort(a, 1, kind="stable")[:, : i.max() + 1], np.argsort(b, 1, kind="stable")[:, : j.max() + 1]
        sums = np.take_along_axis(a, near_a, 1)[:, i] + np.take_along_axis(b, near_b, 1)[:, j]
        cells = near_a[:, i] * self.k + near_b[:, j]
        return np.take_along_axis(cells, np.argsort(sums, 1, kind="stable")[:, :count], 1)

    def ranks(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Place of each of the `cells` in the order of the row beside it."""
        a, b = self.sides(rows)
        own = a[np.arange(len(rows)), cells // self.k] + b[np.arange(len(rows)), cells % self.k]
        return np.array([((x[:, None] + y[None, :]) < s).sum() for x, y, s in zip(a, b, own, strict=True)], np.int64)


def _matrix(column) -> np.ndarray:
    return long_lists(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column]), np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    # Large or small components are scaled first, so that no square overflows or vanishes.
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place) of which those that join what was apart, kept."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    keep = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(n)
    return a[keep], b[keep]


def _meet(least: float, size: int):
    """Counts and links of the visits (side 1) and the filed vectors (side 0) of one block of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, 3):
            side = rows.column("side").to_numpy()
            filed, asking = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(filed) or not len(asking):
                continue
            rep, copies, home = (rows.column(c).to_numpy() for c in ("rep", "copies", "home"))
            unit = _unit(_matrix(rows.column("embedding")))
            # The visits of the filed rows as sorted keys of (row, cell).
            lists = rows.column("visits").combine_chunks()
            lists = lists.take(pa.array(filed))
            cells = lists.flatten().to_numpy()
            span = int(max(cells.max(), home.max())) + 1
            keys = np.sort(np.repeat(filed, np.diff(lists.offsets.to_numpy())) * span + cells)
            for at in range(0, len(asking), 512):
                part = asking[at : at + 512]
                x, y = np.nonzero(unit[part] @ unit[filed].T >= least - _SLACK)
                x, y = part[x], filed[y]
                good = rep[x] != rep[y]
                # y's own visits reach x's home: then the task there sees the pair too, and the smaller id's visit counts.
                wanted = y * span + home[x]
                good &= ~((keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted) & (rep[y] < rep[x]))
                x, y = x[good], y[good]
                if not len(x):
                    continue
                ids = np.concatenate((rep[x], rep[y]))
                gains = np.concatenate((copies[y], copies[x]))
                names, place = np.unique(ids, return_inverse=True)
                a, b = _forest(place[: len(x)], place[len(x) :])
                total = np.zeros(len(names), np.int64)
                np.add.at(total, place, gains)
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.nulls(len(names), pa.int64())], ["a", "links", "b"])
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), none, pa.array(names[b])], ["a", "links", "b"])

    return run


def near_embeddings(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of `vectors`: vec_id, n_links, component_id, kept, and recall: the share of their partners that queries which had no part in choosing the visits find (1 where they have none).

    Two vectors are linked if found and their cosine, in double precision, is `least` or more (exact but for
    rounding of 1e-12). n_links counts the other rows linked directly, copies included. Vectors that are null, empty, zero, or
    hold null or non-finite components link with nothing. Vectors of each size are compared with each other, by an index of their own.
    Copies of one vector are compared once. Rows without an id link with nothing and are kept. Repeated ids count as
    rows of their own. Other columns are not looked at; no rows give no rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    e = F.col("embedding")
    sound = F.coalesce(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("sound", sound)
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    size = F.size("embedding")
    # Vectors of different sizes have no cosine; as a rule there is one size.
    sizes = [r[0] for r in rows.where("sound").select(size.alias("size")).distinct().orderBy("size").collect()]
    each = [_of_one_size(rows.where(F.col("sound") & (size == n)).select("vec_id", F.transform("embedding", lambda x: x + 0.0).alias("embedding")), n, least) for n in sizes]
    return reduce(DataFrame.union, each, alone)


def _of_one_size(rows: DataFrame, size: int, least: float) -> DataFrame:
    """`near_embeddings` of sound vectors (vec_id, embedding) of one size."""
    classes = cut(rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    index, count, recall = _fit(classes, size, least)

    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(index)  # 2 * K * dimension numbers, K bounded by the sample

    def file(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit = _unit(_matrix(part.column(0)))
                visits = list(sent.value.visits(unit, count))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in visits]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(visits)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.cell(unit)), lists], ["embedding", "rep", "copies", "home", "visits"])

    filed = cut(classes.mapInArrow(tidy(file), "embedding array<double>, rep long, copies long, home long, visits array<long>"))
    # Only the filed side is asked for its visits.
    asked = filed.withColumn("cell", F.explode("visits")).withColumn("visits", F.lit(None).cast("array<long>"))
    sizes = filed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n")).join(asked.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    sizes = cut(sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("x"), F.ceil(F.col("m") / BLOCK).cast("int").alias("y")))
    here = filed.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("bx", F.pmod(F.xxhash64("rep"), F.col("x")).cast("int")).withColumn("by", F.explode(F.sequence(F.lit(0), F.col("y") - 1)))
    there = asked.join(sizes, "cell").withColumn("by", F.pmod(F.xxhash64("rep"), F.col("y")).cast("int")).withColumn("bx", F.explode(F.sequence(F.lit(0), F.col("x") - 1)))
    columns = ["cell", "bx", "by", "rep", "copies", "home", "embedding", "visits"]
    met = here.select(*columns, F.lit(0).alias("side")).union(there.select(*columns, F.lit(1).alias("side")))
    met = met.repartition("cell", "bx", "by").sortWithinPartitions("cell", "bx", "by")
    found = cut(met.mapInArrow(tidy(_meet(least, size)), "a long, links long, b long"))

    links = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null").select("a", "b")).toDF("rep", "component")
    named = classes.join(links, "rep", "left").join(groups, "rep", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return (
        rows.join(named, "embedding")
        .select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
        .withColumn("recall", F.lit(float(recall)))
    )


def _fit(classes: DataFrame, size: int, least: float) -> tuple[MultiIndex, int, float]:
    """(index, cells to visit, recall on other queries).

    Codebooks come from at most TRAIN vectors, the visits from queries compared with all rows by brute force in the tasks, which return counts by query and
    rank. Where too few of these have partners, made ones at the least cosine, in random directions, take their place (see `_made`); nothing then depends on how many
    partners there are. The recall is measured on queries whose id is divisible by UNSEEN, which had no part in either; if it is below LEAST_RECALL, they are
    heeded too."""
    total = classes.count()
    rank, unseen = F.xxhash64(F.lit(5), "rep"), F.col("rep") % UNSEEN == 0
    ordered = lambda rows, n: rows.where(F.pmod(rank, F.lit(1 << 20)) < math.ceil(2 * n / total * (1 << 20))).orderBy(rank).limit(n)
    sample = _unit(_matrix(ordered(classes, TRAIN).select("embedding").toArrow().column(0)))
    k = int(np.clip(round(math.sqrt(total / CELL)), 2, max(2, len(sample) // 8)))
    index = MultiIndex(sample, k)
    for probes in PROBES:
        ranks, share = _measure(classes, index, ordered(classes.where(~unseen), probes).select("rep", "embedding").toArrow(), least)
        if probes >= total or share.sum() >= ENOUGH - 0.5:
            break
    if share.sum() < ENOUGH - 0.5:
        made, weight = _made(index, sample[:MADE], least)
        ranks, share = np.concatenate((ranks, made)), np.concatenate((share, weight))

    def need(ranks: np.ndarray, share: np.ndarray) -> int:
        order = np.argsort(ranks)
        reached = share[order].cumsum() / share.sum()
        found = int(ranks[order][min(np.searchsorted(reached, TARGET), len(order) - 1)]) + 1
        return min(max(4, found + found // 4), k * k)  # a few cells more than measured, as the queries are a sample

    count = need(ranks, share)
    ranks, share = _measure(classes, index, ordered(classes.where(unseen), PROBES[-1]).select("rep", "embedding").toArrow(), least)
    recall = lambda: float(share[ranks < count].sum() / share.sum()) if len(ranks) else 1.0
    if recall() < LEAST_RECALL:
        count = max(count, need(ranks, share))
    return index, count, recall()


def _made(index: MultiIndex, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, weights) of one made partner for each row, of cosine `least`: the rank at which the pair is seen from either side."""
    rng = np.random.default_rng(7)
    beside = rng.normal(size=rows.shape)
    beside -= (beside * rows).sum(1, keepdims=True) * rows
    size = np.sqrt((beside**2).sum(1, keepdims=True))
    rows, beside = rows[size[:, 0] > 1e-9], (beside / np.maximum(size, 1e-9))[size[:, 0] > 1e-9]  # vectors of one component have no other direction
    partners = _unit(least * rows + math.sqrt(1 - least * least) * beside) if len(rows) else rows
    if not len(rows):
        return np.zeros(1, np.int64), np.ones(1)
    parts = np.array_split(np.arange(len(rows)), len(rows) // 512 + 1)
    there = np.concatenate([index.ranks(rows[p], index.cell(partners[p])) for p in parts])
    back = np.concatenate([index.ranks(partners[p], index.cell(rows[p])) for p in parts])
    return np.minimum(there, back), np.ones(len(rows))


def _measure(classes: DataFrame, index: MultiIndex, asked: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, for each the sum over queries of the share of their partners there); a query with partners sums to 1."""
    if not asked.num_rows:
        return np.zeros(0, np.int64), np.zeros(0)
    queries, ids = _unit(_matrix(asked.column(1))), asked.column(0).to_numpy()
    sent = classes.sparkSession.sparkContext.broadcast((index, queries, ids, index.cell(queries)))

    def run(batches):
        index, queries, ids, homes = sent.value
        cells_all = index.k * index.k
        found: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit, rep = _unit(_matrix(part.column(0))), part.column(1).to_numpy()
                cells = index.cell(unit)
                for first in range(0, len(queries), 1024):
                    q, y = np.nonzero(queries[first : first + 1024] @ unit.T >= least - _SLACK)
                    q += first
                    good = ids[q] != rep[y]
                    q, y = q[good], y[good]
                    if not len(q):
                        continue
                    # Rank of a cell for a query, and of a query's cell for a row: each combination once.
                    there, back = q * cells_all + cells[y], y * cells_all + homes[q]
                    ranks = np.minimum(_ranks_once(index, queries, there), _ranks_once(index, unit, back))
                    names, n = np.unique(q * cells_all + ranks, return_counts=True)
                    for name, m in zip(names.tolist(), n.tolist(), strict=True):
                        found[name] = found.get(name, 0) + m
        names = np.array(list(found), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names // cells_all), pa.array(names % cells_all), pa.array(list(found.values()), pa.int64())], ["query", "rank", "n"])

    counts = classes.select("embedding", "rep").mapInArrow(tidy(run), "query long, rank long, n long").groupBy("query", "rank").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("query"))).groupBy("rank").agg(F.sum("share").alias("share")).toArrow()
    return counts.column("rank").to_numpy(), counts.column("share").to_numpy()


def _ranks_once(index: MultiIndex, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """index.ranks of keys (row * K * K + cell), each different key once."""
    names, place = np.unique(keys, return_inverse=True)
    cells = index.k * index.k
    return np.concatenate([index.ranks(rows[part // cells], part % cells) for part in np.array_split(names, len(names) // 4096 + 1)])[place]


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))
