"""Operator 13: what five filters take out in every order, and what each is worth (an audit of their interactions).

One scan gives the failures that a text shows by itself. Whether a smaller id has the same text is a left-semi join on
hash, exact text and smaller id; only hashes that repeat bring their texts to it. The ids that it marks are united with
the other failures and added up to one row for each combination of failed filters in a part, at most 32 for a part, from
which all 120 orders follow: what a filter removes depends only on the set of filters before it."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, dealt, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
_COUNTS = ("n", "good", "toxic")


def own_failures(text: Column) -> Column:
    """The bits of A to D: under 100 words; under 80 % of the words different; over 10 % of the characters A to Z; a mark of #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    tests = {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 10,
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }
    bits = F.lit(0)
    for name, failed in tests.items():
        bits = bits.bitwiseOR(F.when(failed, _BIT[name]).otherwise(0))
    return bits


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits, n): the rows that fail a filter, by id and text hash, with the bits of all filters that they fail.

    Rows that repeat an id are judged one by one. A row without an id is no copy of any other, and none of it."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))
    scanned = cut(rows.select("doc_id", "part", "h", own_failures(F.col("text")).alias("bits")))
    hashes = cut(scanned.where("doc_id is not null").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))

    # the texts of repeated hashes, and of each such text the least id
    left, right = dealt(rows.where("doc_id is not null"), hashes, "h", "n", F.col("doc_id"))
    suspects = cut(left.join(right.select("h", "deal").hint("merge"), ["h", "deal"], "left_semi").drop("deal"))
    firsts = cut(suspects.groupBy("h", "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    left, right = dealt(suspects, firsts.withColumnRenamed("text", "same"), "h", "n", F.col("doc_id"))
    right = right.select(F.col("h").alias("rh"), F.col("deal").alias("rdeal"), "same", "first").hint("merge")
    copies = left.join(right, (F.col("h") == F.col("rh")) & (F.col("deal") == F.col("rdeal")) & (F.col("text") == F.col("same")) & (F.col("first") < F.col("doc_id")), "left_semi")

    found = scanned.where("bits <> 0").select("doc_id", "part", "h", "bits", F.lit(1).alias("n"))
    # a copy that fails nothing else is counted here, once for each of its rows
    marked = copies.select("doc_id", "part", "h", F.lit(_BIT["E"]).alias("bits"), F.when(own_failures(F.col("text")) == 0, 1).otherwise(0).alias("n"))
    united = found.union(marked).groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return united.select("doc_id", "part", "bits", "n")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each combination of failed filters, and how many of them are labelled quality 1, and toxic 1.

    An id that is labelled twice counts as labelled so if one of its labels says it."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failures(docs).join(marks.where("good = 1 or toxic = 1"), "doc_id", "left")
    sums = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))]
    return rows.groupBy("part", "bits").agg(*sums)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (a lang; null and empty are one part), order of the five filters and step.

    Columns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley. Null texts count as empty;
    other columns are not looked at. No documents give no rows; a filter that nothing fails gives zeros."""
    parts = docs.groupBy(F.coalesce("lang", F.lit("")).alias("part")).agg(F.count("*").alias("total"))
    combos = cut(combinations(docs, labels))

    # every filter with every set of filters before it
    pairs = [(_BIT[f], before) for f in FILTERS for before in range(32) if not before & _BIT[f]]
    sets = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(b).alias("before")) for f, b in pairs))).alias("s")
    removed = (F.col("bits").bitwiseAND(F.col("f")) != 0) & (F.col("bits").bitwiseAND(F.col("before")) == 0)
    redundant = (F.col("bits").bitwiseAND(F.col("f")) != 0) & (F.col("bits").bitwiseAND(F.col("before")) != 0)
    count = lambda when, what: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).alias
    effects = (
        combos.select("*", sets)
        .select("part", "bits", *_COUNTS, "s.*")
        .groupBy("part", "f", "before")
        .agg(
            count(removed, "n")("removed"),
            count(redundant, "n")("redundant"),
            count(F.col("bits") == F.col("f"), "n")("unique_fails"),
            count(removed, "good")("good_lost"),
            count(removed, "toxic")("toxic_lost"),
            count(F.col("bits").bitwiseAND(F.col("f").bitwiseOR(F.col("before"))) != 0, "n")("gone"),
        )
    )
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(4 - k)) for k in range(5))), F.bit_count("before") + 1)
    worth = effects.groupBy("part", "f").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    effects = effects.join(worth, ["part", "f"])

    bit = lambda letter: F.element_at(F.create_map(*(x for k, v in _BIT.items() for x in (F.lit(k), F.lit(v)))), letter)
    before = F.aggregate(F.slice(F.split("filter_order", ""), 1, F.col("step") - 1), F.lit(0), lambda a, x: a.bitwiseOR(bit(x)))
    steps = (
        parts.select("*", F.explode(F.lit(ORDERS)).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
        .withColumns({"f": bit(F.substring("filter_order", F.col("step"), F.lit(1))), "before": before})
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return steps.join(effects, ["part", "f", "before"], "left").select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - zero("gone")).cast("long").alias("kept"),
        *(zero(c).alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")),
    )


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_MASK = " + ".join(f"CASE WHEN instr({{0}}, '{k}') > 0 THEN {v} ELSE 0 END" for k, v in _BIT.items())

#: DuckDB SQL for the rows of op13.
ORACLE = f"""WITH t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), b AS (
    SELECT t.doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
    FROM t LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = t.doc_id
), f(l, f) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e
    WHERE a.f + b.f + c.f + d.f + e.f = 31 AND (a.f | b.f | c.f | d.f | e.f) = 31
), s AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, f.f, {_MASK.format("left(filter_order, step - 1)")} AS before
    FROM o, range(1, 6) r(step) JOIN f ON f.l = substr(filter_order, step, 1)
), c AS (
    SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY 1, 2
), r AS (
    SELECT part, filter_order, step, f, sum(CASE WHEN bits & (f | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN bits & f <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN bits & f <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bits = f THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN bits & f <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bits & f <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
