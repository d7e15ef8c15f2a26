"""Learned mapping: neighbour votes, fused decisions, a softmax classifier."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_tokens


def vote(neighbours: DataFrame, k: int = 10) -> DataFrame:
    """(query, label, vote, votes, place): similarity summed by label over the k nearest (ties by ordinal).

    Places by vote, ties: the smaller label; the winner among equal votes is by rule the larger label, see `winner`."""
    near = Window.partitionBy("query").orderBy(F.desc("similarity"), "ordinal")
    rows = neighbours.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k)
    sums = rows.groupBy("query", "label").agg(F.round(F.sum("similarity"), 4).alias("vote"), F.count("*").alias("votes"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("vote"), "label")).cast("long"))


def winner(votes: DataFrame, best: DataFrame | None = None, vote_floor: float = 0.0, best_floor: float = 0.0) -> DataFrame:
    """(query, label, vote): the largest (vote, label), unless it is below its floor, or the nearest similarity (query, best) is."""
    top = votes.groupBy("query").agg(F.max(F.struct("vote", "label")).alias("t")).select("query", "t.label", "t.vote").where(F.col("vote") >= vote_floor)
    return top if best is None else top.join(best.where(F.col("best") >= best_floor), "query", "left_semi")


def fuse(one: DataFrame, two: DataFrame, floor: float = 3.0) -> DataFrame:
    """The winner of the summed votes of two voters, if it reaches the floor."""
    return winner(one.select("query", "label", "vote").union(two.select("query", "label", "vote")).groupBy("query", "label").agg(F.round(F.sum("vote"), 4).alias("vote")), vote_floor=floor)


def decide(probabilities: DataFrame, votes: DataFrame, most: int = 2, least: float = 0.2) -> DataFrame:
    """(query, label, score, place): .7 * probability + .3 * share of votes, at most `most` from `least` up; ties by label."""
    total = votes.groupBy("query").agg(F.sum("vote").alias("total"))
    share = votes.join(total, "query").select("query", "label", (F.col("vote") / F.nullif(F.col("total"), F.lit(0.0))).alias("share"))
    rows = probabilities.join(share, ["query", "label"], "full").select("query", "label", F.round(0.7 * F.coalesce("p", F.lit(0.0)) + 0.3 * F.coalesce("share", F.lit(0.0)), 4).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "label")
    return rows.where(F.col("score") >= least).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def strongest(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The best score of each key and where it was first reached (by ordinal)."""
    best = F.max_by(F.struct("score", "ordinal"), F.struct("score", -F.col("ordinal"))).alias("b")
    return scores.groupBy(*keys).agg(best).select(*keys, "b.score", "b.ordinal")


def gram_vectors(docs: DataFrame, doc: str, text: str, least_df: int = 2) -> DataFrame:
    """(doc, term, w): unit TF-IDF vectors of one- and two-word terms that `least_df` documents have, with weights (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1)."""
    words = docs.select(F.col(doc).alias("doc"), search_tokens(F.col(text)).alias("t"))
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    counts = words.select("doc", F.explode(F.concat("t", pairs)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("n"))
    total = docs.count()
    weights = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df).select("term", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = counts.join(weights, "term").select("doc", "term", ((1 + F.log("n")) * F.col("idf")).alias("w"))
    norms = rows.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


def softmax_classifier(train: DataFrame, rows: DataFrame, vector: str, label: str, strength: float = 30.0, rounds: int = 60) -> DataFrame:
    """`rows` with p: array of class probabilities, from a multinomial regression on `train` (numeric labels from 0)."""
    model = LogisticRegression(featuresCol="_v", labelCol="_y", family="multinomial", regParam=1.0 / (strength * max(1, train.count())), standardization=False, maxIter=rounds)
    fitted = model.fit(train.select(array_to_vector(vector).alias("_v"), F.col(label).cast("double").alias("_y")))
    return fitted.transform(rows.withColumn("_v", array_to_vector(vector))).withColumn("p", vector_to_array("probability")).drop("_v", "rawPrediction", "probability", "prediction")


def quantise(vector: Column) -> Column:
    """Components times 127, rounded, as small integers."""
    return F.transform(vector, lambda x: F.round(x * 127).cast("tinyint"))


def dequantise(vector: Column) -> Column:
    return F.transform(vector, lambda x: x / F.lit(127.0))


def per_report_cap(suggestions: DataFrame, floor: float = 0.7, most: int = 5) -> DataFrame:
    """Suggestions (doc, technique, vote, sentences) of a report: of one with several sentences, the `most` strongest from `floor`; of one sentence, all."""
    order = Window.partitionBy("doc").orderBy(F.desc("vote"), "technique")
    several = F.col("sentences") > 1
    rows = suggestions.where(~several | (F.col("vote") >= floor)).withColumn("place", F.row_number().over(order).cast("long"))
    return rows.where(~several | (F.col("place") <= most))


def align_vectors(examples: DataFrame, stored: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """`examples` (key, …) with unit vectors v: the stored one of the key (key, v), else the freshly embedded one (key, v), else null."""
    known = examples.join(stored.groupBy("key").agg(F.first("v").alias("v")), "key", "left")
    if embedded is not None:
        known = known.join(embedded.groupBy("key").agg(F.first("v").alias("_fresh")), "key", "left").withColumn("v", F.coalesce("v", "_fresh")).drop("_fresh")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return known.withColumn("_norm", norm).withColumn("v", F.transform("v", lambda x: x.cast("double") / F.col("_norm"))).drop("_norm")
