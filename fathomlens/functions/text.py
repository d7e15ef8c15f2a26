"""Text column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that a search ignores, and the patterns of ids and sentence ends.
STOP_WORDS = (
    "a about after again against all also am an and any are as at be because been before being below between both but by can cannot could did do does doing "
    "done down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not of "
    "off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through "
    "to too under until up us very was we were what when where which while who whom why will with would you your yours ever seen get got give take tell "
    "show "
).split()

CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
TECHNIQUE = r"\bT\d{4}(?:\.\d{3})?\b"
SENTENCE_END = r"(?<=[.!?;])\s+|\n+"


def search_tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens of a letter or digit and then letters, digits, dots and hyphens; none ends in dot or hyphen.

    Stop words go, repetitions stay; null gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9][a-z0-9.-]*)"), 1)
    trimmed = F.transform(found, lambda x: F.regexp_replace(x, "[.-]+$", ""))
    return F.filter(trimmed, lambda x: ~x.isin(stop))


def extract_ids(text: Column, pattern: str) -> Column:
    """Distinct upper-cased matches in the order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1), F.upper))


def sentences(text: Column, least: int = 4) -> Column:
    """Sentences of `least` words or more."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), F.trim)
    return F.filter(parts, lambda x: F.size(F.split(x, r"\s+")) >= least)


def family(technique: Column) -> Column:
    """T1059.001 -> T1059."""
    return F.substring_index(technique, ".", 1)


def pretty(label: Column) -> Column:
    """data_breach -> Data Breach; null and empty -> Unknown."""
    return F.when(F.coalesce(label, F.lit("")) == "", "Unknown").otherwise(F.initcap(F.translate(label, "_-", "  ")))


def is_arabic(text: Column) -> Column:
    """Whether any letter is of the Arabic block."""
    return F.coalesce(F.rlike(text, F.lit("[؀-ۿ]")), F.lit(False))


def mask_subject(sentence: Column, name: Column, instead: str = "the actor") -> Column:
    """The sentence with a name of three letters or more replaced, whatever its case; the name is taken literally."""
    quoted = F.concat(F.lit("(?i)\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(F.length(name) >= 3, F.regexp_replace(sentence, quoted, F.lit(instead))).otherwise(sentence)


def mask_value(value: Column) -> Column:
    """For audits: at most four characters become stars, longer ones keep two at each end."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))


def highlight_tokens(text: Column) -> Column:
    """Redaction tokens wrapped in a mark element."""
    return F.regexp_replace(text, r"(\[[A-Z_]+_REDACTED(?:_\d+)?\])", "<mark>$1</mark>")


#: Bits of a word filter, whatever the number of words.
FILTER_BITS = 1 << 16


def word_filter(words: DataFrame) -> Callable[[Column], Column]:
    """A test for words, to be used in a row before any join: true for every word of the only column of `words`, and for few others as long as there are under some FILTER_BITS / 4.

    One hash into FILTER_BITS bits, set by Spark and held as longs in the plan."""
    place = lambda word: F.pmod(F.xxhash64(word), F.lit(FILTER_BITS)).cast("int")
    spots = words.select(place(F.col(words.columns[0])).alias("p")).distinct()
    bits = spots.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63))).alias("b"))
    held = [0] * (FILTER_BITS // 64)
    for r in bits.collect():  # at most FILTER_BITS / 64 rows
        held[r.i] = r.b
    field = F.from_json(F.lit(str(held)), "array<bigint>")
    return lambda word: F.getbit(F.get(field, F.shiftright(place(word), 6)), place(word).bitwiseAND(63)) == 1
