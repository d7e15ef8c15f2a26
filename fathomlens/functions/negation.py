"""What a text denies: one scan for each text, linear in its length.

A small Python helper, as column expressions can't carry positions along: the places of cues, clause ends, commas and
conjunctions are found once, and each cue then looks up by bisection where its span ends."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What denies a thing (its scope is the phrase that follows) or an action (the rest of the clause), what ends a clause, and how far a denial reaches, in words.
NOUN_CUES = ["no evidence of", "no sign of", "no signs of", "no indication of", "absence of", "lack of", "before any", "rather than", "instead of", "without", "neither", "none", "no"]
VERB_CUES = (
    "did not|does not|do not|was not|were not|is not|are not|has not|have not|had not|could not|would not|cannot|can not|failed to|unable to|didn't|doesn't|don't|wasn't|weren't|isn't|aren't|hasn't|"
    "haven't|hadn't|couldn't|wouldn't|can't|never|not|nor"
).split("|")
CLAUSE_ENDS = r"[.;:!?\n]|\b(?:but|however|although|while|whereas|until|whose|which|who|where|because)\b"
NOUN_REACH, VERB_REACH = 8, 12
WORD = "[a-z0-9]+"
TOKEN = r"\[[A-Z_]+_REDACTED(?:_\d+)?\]"

_CUE = re.compile(rf"\b(?:({'|'.join(NOUN_CUES)})|(?:{'|'.join(VERB_CUES)}))\b")
_END, _AND, _LIST, _COMMA, _RUN, _WORD = (re.compile(x) for x in (CLAUSE_ENDS, r"\band\b", r"\b(?:or|nor)\b", ",", r"\S+", WORD))


def _lowered(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def spans(low: str) -> list[tuple[int, int]]:
    """(start, end) in characters of what a lower-cased text denies, by start.

    A span begins after its cue and ends with the clause; after a denied action also at the word and; at a comma, unless the clause is a list with
    or or nor; and after NOUN_REACH or VERB_REACH words."""
    cues = list(_CUE.finditer(low))
    if not cues:
        return []
    starts = lambda pattern: [m.start() for m in pattern.finditer(low)]
    ends, ands, lists, commas = map(starts, (_END, _AND, _LIST, _COMMA))
    runs = [m.span() for m in _RUN.finditer(low)]
    after = lambda places, at, end: places[i] if (i := bisect_left(places, at)) < len(places) and places[i] < end else end
    out = []
    for cue in cues:
        start = cue.end()
        end = after(ends, start, len(low))
        if not cue[1]:
            end = after(ands, start, end)
        comma = after(commas, start, end)
        if comma < end and after(lists, start, end) == end:
            end = comma
        over = bisect_right(runs, start, key=lambda run: run[1]) + (NOUN_REACH if cue[1] else VERB_REACH)
        if over < len(runs) and runs[over][0] < end:
            end = runs[over - 1][1]
        if end > start:
            out.append((start, end))
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """The spans of a text as places of words (runs of a-z and digits of the lower-cased text), from 1; those without a word are left out."""
    low = _lowered(text)
    if not (found := spans(low)):
        return []
    words = [m.start() for m in _WORD.finditer(low)]
    places = ((bisect_left(words, a) + 1, bisect_left(words, b) + 1) for a, b in found)
    return [(a, b) for a, b in places if b > a]


def blanked(text: str) -> str:
    """The text with one space for each character that it denies, and for each redaction token."""
    parts, at = [], 0
    for start, end in spans(_lowered(text)):  # by start, so merging needs no more than the last end
        if end > at:
            start = max(start, at)
            parts += [text[at:start], " " * (end - start)]
            at = end
    return re.sub(TOKEN, " ", "".join([*parts, text[at:]]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _negations(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """One text at a time is an object of Python; the spans of a batch are held as two arrays of numbers."""
    for some in texts:
        places, ends = array("q"), array("q", [0])
        for t in some:
            for span in word_spans(t.as_py() or ""):
                places.extend(span)
            ends.append(len(places) // 2)
        flat = np.frombuffer(places, np.int64).reshape(-1, 2)
        spans_ = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
        yield pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int64).astype(np.int32)), spans_)


@F.pandas_udf(T.StringType())
def _affirmed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield some.map(lambda t: blanked(t) if t else t)


def negations(text: Column) -> Column:
    """array<struct<start, end>>: the places of words that the text denies, see `word_spans`; none for null."""
    return _negations(text)


def affirmed_text(text: Column) -> Column:
    """`blanked` of each text; null for null."""
    return _affirmed(text)
