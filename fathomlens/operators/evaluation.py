"""Evaluation: intervals, set metrics, ranking metrics, leaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.negation import TOKEN
from ..functions.text import word_filter


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval, rounded to 4 places; (0, 0) of nothing."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p = successes / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.coalesce(F.round((centre - spread) / scale, 4), F.lit(0.0)), F.coalesce(F.round((centre + spread) / scale, 4), F.lit(0.0))


def prf(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 over distinct key rows."""
    a, b = expected.select(*keys).distinct().withColumn("e", F.lit(1)), found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = a.join(b, keys, "full")
    sums = both.agg(F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    p = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return sums.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def accuracy(rows: DataFrame, accepted: str, found: str) -> DataFrame:
    """One row: correct, total, rate and interval; an answer is right if it is one of the accepted ones."""
    right = F.count_if(F.coalesce(F.array_contains(accepted, F.col(found)), F.lit(False)))
    sums = rows.agg(right.alias("correct"), F.count("*").alias("total"))
    low, high = wilson(F.col("correct"), F.col("total"))
    return sums.select("correct", "total", F.round(F.col("correct") / F.col("total"), 4).alias("rate"), low.alias("low"), high.alias("high"))


def ranking_metrics(ranked: DataFrame, k: int = 5) -> DataFrame:
    """One row over ranked results (query, place, relevant): queries, P@1, hit rate at k, pooled P@k and MRR.

    Queries without any result count in the first, not in the pool. P@k is the sum of relevant over the sum of results."""
    per = ranked.groupBy("query").agg(
        F.min(F.when(F.col("relevant"), F.col("place"))).alias("first"), F.count_if(F.col("relevant") & (F.col("place") <= k)).alias("good"), F.count_if(F.col("place") <= k).alias("shown")
    )
    return per.agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.coalesce("first", F.lit(0)) == 1).cast("double")), 4).alias("p_at_1"),
        F.round(F.avg((F.coalesce("first", F.lit(10**9)) <= k).cast("double")), 4).alias("recall_at_k"),
        F.round(F.sum("good") / F.sum(F.greatest("shown", F.lit(1))), 4).alias("p_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )


def leaks(outputs: DataFrame, identifiers: DataFrame, doc: str, text: str, whole_words: bool = False) -> DataFrame:
    """Identifiers (doc, identifier) that are still in their document's output, as a substring or as whole words."""
    rows = identifiers.join(outputs.select(F.col(doc).alias("doc"), F.lower(text).alias("_out")), "doc")
    low = F.lower("identifier")
    if not whole_words:
        return rows.where(F.contains("_out", low)).drop("_out")
    # Boundaries are letters and digits; the identifier is taken literally.
    return rows.where(F.rlike("_out", F.concat(F.lit(r"(?:^|[^a-z0-9])\Q"), low, F.lit(r"\E(?:$|[^a-z0-9])")))).drop("_out")


def _plain_words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text, without redaction tokens."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), TOKEN, " ")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def residual_audit(outputs: DataFrame, values: DataFrame, doc: str, text: str, least: int = 4) -> DataFrame:
    """(doc, value, at): where a value that was taken out anywhere still stands in any output, as the same run of words whatever is between them; at counts words, from 1.

    Independent of what found the values: values (value) of the whole corpus are searched in every output at once, so a name that was taken out of one report and not
    of another shows. Values under `least` characters are not searched for. A filter of first words, of a fixed size, picks in the row the places where a value may
    begin; there, as many words as values have are joined with the values themselves, so a frequent first word makes no hot key."""
    known = values.select(F.col("value"), _plain_words(F.col("value")).alias("words")).where((F.length("value") >= least) & (F.size("words") > 0)).distinct()
    known = known.select("value", F.array_join("words", " ").alias("run"), F.size("words").alias("n"), F.get("words", F.lit(0)).alias("first"))
    begins = word_filter(known.select("first"))
    lengths = [r.n for r in known.select("n").distinct().orderBy("n").collect()]  # as many as the longest value has words
    rows = outputs.select(F.col(doc).alias("doc"), _plain_words(F.col(text)).alias("words"))
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: begins(s["w"]))
    run = lambda i, n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("run"))
    runs = F.flatten(F.transform(spots, lambda s: F.transform(F.filter(F.lit(lengths or [1]), lambda n: s["i"] + n <= F.size("words")), lambda n: run(s["i"], n))))
    found = rows.select("doc", F.explode(runs).alias("r")).select("doc", "r.*").join(known.select("value", "run"), "run")
    return found.select("doc", "value", (F.col("i") + 1).cast("long").alias("at"))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x.getField(name)


def _told(path: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(path).alias("path"), x.alias("text"))


def leaves(schema: T.StructType) -> dict[str, Column]:
    """Every leaf of a schema as a column array<string>, by its path: fields of structs, elements of arrays, keys and values of maps, however nested."""

    def walk(name: str, column: Column, kind: T.DataType) -> Iterator[tuple[str, Column]]:
        """`column` is an array of values of `kind`."""
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f"{name}.{f.name}", F.transform(column, _field(f.name)), f.dataType)
        elif isinstance(kind, T.ArrayType):
            yield from walk(f"{name}[]", F.flatten(F.filter(column, lambda x: x.isNotNull())), kind.elementType)
        elif isinstance(kind, T.MapType):
            filled = F.filter(column, lambda x: x.isNotNull())
            yield from walk(f"{name}{{key}}", F.flatten(F.transform(filled, F.map_keys)), kind.keyType)
            yield from walk(f"{name}{{value}}", F.flatten(F.transform(filled, F.map_values)), kind.valueType)
        else:
            yield name, F.transform(column, lambda x: x.cast("string"))

    return {path: c for f in schema.fields for path, c in walk(f.name, F.array(F.col(f"`{f.name}`")), f.dataType)}


def exposures(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, path, value): every place of any column, however nested, that holds one of `values` (value), whatever its case, as whole words; the key column is not looked at.

    Rows become their leaves in one projection; see `residual_audit` for the search."""
    found = leaves(T.StructType([f for f in rows.schema.fields if f.name != key]))
    each = F.flatten(F.array(*(F.transform(F.coalesce(c, F.array().cast("array<string>")), _told(path)) for path, c in found.items())))
    texts = rows.select(F.col(f"`{key}`").alias("key"), F.explode(each).alias("leaf")).select(F.struct("key", "leaf.path").alias("at"), "leaf.text").where("text is not null")
    hits = residual_audit(texts, values, "at", "text", least=1)
    return hits.select(F.col("doc.key").alias(key), F.col("doc.path").alias("path"), "value").distinct()


def removal_rates(audited: DataFrame) -> DataFrame:
    """(category, marked, removed, rate) of (category, survived)."""
    sums = audited.groupBy("category").agg(F.count("*").alias("marked"), F.count_if(~F.col("survived")).alias("removed"))
    return sums.withColumn("rate", F.round(F.col("removed") / F.col("marked"), 4))


def held_out(source: Column, one_in: int = 5) -> Column:
    """Whole sources are held out, one in `one_in`, by a hash of their name."""
    return F.pmod(F.crc32(source.cast("binary")), F.lit(one_in)) == 0


def preserved(raw: DataFrame, sanitized: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: how often each column is the same before and after sanitising."""
    pairs = raw.alias("a").join(sanitized.alias("b"), key)
    same = [F.count_if(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_same") for c in columns]
    return pairs.agg(F.count("*").alias("total"), *same)
