"""A corpus pipeline of five stages, each one of the operators in fathomlens.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all their columns and values; the last returns
token ids and decoded texts in place of the texts. Columns that are named like those that an operator adds keep the caller's
values. An empty table gives an empty table. Stages need the columns doc_id and text; no other is looked at, but lang by
the first, to learn from. Texts of any length are judged whole, and rows are judged one by one, repeated ones alike, except where near-dedup says otherwise."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlens.llm import language_id, quality
from fathomlens.llm.bpe import bpe_round_trip
from fathomlens.llm.decontaminate import benchmark_matches
from fathomlens.llm.near_dedup import near_duplicates
from fathomlens.llm.shared import cut, held_out, table

#: A document goes if its largest language share is below this.
LEAST_SHARE = 0.5
#: Rows that a Python worker is given at once, where the session has Spark's default: with texts of some KB, 10000 rows are tens of MB in the executor and again in each worker.
BATCH_ROWS = 1000
_ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Set BATCH_ROWS for the session, unless the caller has set a number."""
    if spark.conf.get(_ROWS_AT_ONCE) == "10000":
        spark.conf.set(_ROWS_AT_ONCE, BATCH_ROWS)


def _filtered(docs: DataFrame, added: tuple[str, ...], judge: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows of `docs` that `keep` holds for, a condition on columns that `judge` adds; the caller's columns of these names are set aside meanwhile."""
    aside = {c: f"callers {c}" for c in docs.columns if c.lower() in added}
    judged = judge(docs.withColumnsRenamed(aside)).where(keep)
    return judged.select([F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language that has half of their words or more.

    Null and empty texts and those without a letter have no language and go; so do all if no row has a lang to learn from."""
    _small_batches(spark)
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    keep = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    return _filtered(docs, ("lang_pred", "score", "languages"), lambda rows: language_id.predict_languages(rows, model), keep)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of predicted quality 1.

    Null and empty texts get the score of a text without words (the model's bias), and go unless that is one of quality; nothing stays if
    nothing is labelled. Rows without an id are scored, but teach nothing."""
    _small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    return _filtered(docs, ("score", "predicted"), lambda rows: quality.score_quality(rows, model), F.col("predicted") == 1)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    Rows without an id, and null, empty and blank texts are near nothing and stay. Different texts of one id belong together: they
    stay or go as one document. Of rows that repeat an id and a text, the first by its columns as JSON stays."""
    _small_batches(spark)
    judged = near_duplicates(docs, k=5, percent=80).where("doc_id is not null").groupBy("doc_id")
    judged = cut(judged.agg(F.max(~F.col("kept")).alias("gone"), F.count("*").alias("n")).where("gone or n > 1"))
    ids = judged.select(F.col("doc_id").alias("judged id"), "gone", "n")
    aside = {c: f"callers {c}" for c in docs.columns if c.lower() in ("gone", "n")}
    rows = docs.withColumnsRenamed(aside).join(ids, F.col("doc_id") == F.col("judged id"), "left")
    blank = ~F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    rows = rows.where(~F.coalesce("gone", F.lit(False)) | blank)
    own = [F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns]
    if judged.where("n > 1").isEmpty():
        return rows.select(own)
    row = F.struct(own)
    once = rows.where("n > 1").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return rows.where(F.coalesce("n", F.lit(1)) == 1).select(own).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of the benchmark. Null and empty texts hold none and stay."""
    _small_batches(spark)
    benchmark = table(spark, sf_dir, "benchmark")
    return _filtered(docs, ("matches",), lambda rows: benchmark_matches(rows, benchmark), F.size("matches") == 0)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_tokens, ids and decoded (the text that the ids stand for) of each document, with its other columns but the text.

    A null or empty text has no ids and an empty decoded text. The caller's columns of the three names give way."""
    _small_batches(spark)
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "ids", "decoded")]
    coded = bpe_round_trip(docs.select(*rest, "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(*rest, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encode_decode", bpe_stage),
]

#: SQL expresses neither the classifiers nor the alignments.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
