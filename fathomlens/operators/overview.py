"""Corpus overview: counts, breakdowns and rankings, each one shuffle with map-side partial aggregation.

Ties are always broken by label, so that results don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["low", "medium", "high", "critical"]
PHASES = ["detect", "contain", "eradicate", "recover", "harden"]


def ranked(df: DataFrame, label: Column, limit: int | None = None) -> DataFrame:
    """(label, n, place): counts of a label, most frequent first, ties by label. Nulls count as 'unknown'."""
    counts = df.groupBy(F.coalesce(label, F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))
    return placed(counts, [F.desc("n"), F.col("label")], limit)


def placed(df: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """`df` with place, its number in a total order; `limit` keeps the first (a top-k report).

    With a limit, only the first rows of each partition reach the last step. Without one, `df` must be as small as a
    vocabulary, since one task numbers it."""
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def in_order(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """(label, n, place) for every label of a fixed order, zeros included; others are dropped."""
    dim = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order, 1)], "label string, place long")
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "place")


def by_year(df: DataFrame, ts: str, *others: str) -> DataFrame:
    """Counts by year of a timestamp and further columns; rows without a timestamp are left out."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.year(ts).cast("long").alias("year"), *others).agg(F.count("*").alias("n"))


def action_effectiveness(actions: DataFrame, limit: int | None = 8) -> DataFrame:
    """Mean effectiveness of each action (trimmed, lower-cased), with how often it is mentioned, rated or not.

    Actions without any rating are left out. Best mean first, then most used, then by name."""
    key = F.lower(F.trim("action")).alias("action")
    stats = actions.groupBy(key).agg(F.avg("effectiveness").alias("mean"), F.count("*").alias("times_used"))
    stats = stats.where(F.col("mean").isNotNull()).select("action", F.round("mean", 4).alias("mean"), "times_used")
    return placed(stats, [F.desc("mean"), F.desc("times_used"), F.col("action")], limit)


def first_label(df: DataFrame, key: str, label: str, ordinal: Column) -> DataFrame:
    """The label that each key has at its first ordinal."""
    return df.groupBy(key).agg(F.min_by(label, ordinal).alias(label))


def key_figures(incidents: DataFrame, facts: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: incidents, shared, techniques, actions, redactions."""
    one = incidents.agg(
        F.count("*").alias("incidents"), F.count_if(F.col("provenance") == "shared").alias("shared"), F.sum(F.coalesce("redactions", F.lit(0))).cast("long").alias("redactions")
    )
    two = facts.agg(F.count_distinct("technique").alias("techniques"))
    three = actions.agg(F.count("*").alias("actions"))
    return one.join(two).join(three)  # three rows of one


def breakdowns(incidents: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, label, n) for several columns in one pass over the rows, by grouping sets."""
    known = incidents.select(*[F.coalesce(c, F.lit("unknown")).alias(c) for c in columns])
    sets = known.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id(*[F.col(c) for c in columns]).alias("g"))
    full = (1 << len(columns)) - 1
    names = {c: full - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    dimension = F.coalesce(*[F.when(F.col("g") == g, F.lit(c)) for c, g in names.items()])
    label = F.coalesce(*[F.when(F.col("g") == g, F.col(c)) for c, g in names.items()])
    return sets.select(dimension.alias("dimension"), label.alias("label"), "n")


def most_recent(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """The newest rows, those without a date last, ties by key."""
    return placed(df, [F.desc_nulls_last(ts), F.col(key)], n)


def first_k_of_phase(actions: DataFrame, k: int = 3) -> DataFrame:
    """The k best actions of each phase by score, ties by action; phases outside the fixed order are dropped."""
    order = Window.partitionBy("category").orderBy(F.desc("score"), "action")
    return actions.where(F.col("category").isin(PHASES)).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)
