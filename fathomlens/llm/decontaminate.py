"""Operator 3: benchmark decontamination by the q-gram lemma.

Texts are normalised (compatibility forms, no case, no marks, letters and digits with single spaces). A
benchmark item of up to WINDOW bytes is one pattern, a longer one is cut into patterns of WINDOW
bytes that overlap by half; equal patterns of several items are one. A place of a document within k edits of a pattern of w
bytes shares at least w + 1 - (k + 1) q of its w + 1 - q q-grams, and all of them lie on diagonals
(place in the text less place in the pattern) at most k from the match's start. So shared
q-grams are counted in diagonal bands that overlap by 2k; only bands that
reach that bound are retained, and each is verified by banded alignment.

Phrases that many items share would make every such phrase of a document meet all of these items. So q-grams of more than HOT patterns
are not looked up for a pattern, as long as its bound stays above 0: of d such q-grams left out, the bound is less by d. A shared phrase of up to
w - k q - 1 bytes then costs nothing. Bands retained by a lowered bound are counted again with all q-grams of the pattern.
Before the alignment, the lemma is applied once more to the band's region with q-grams of FINE bytes, which a shared phrase has to
fill by two thirds. Alignments run for many bands at a time, and equal regions once.

With an edit budget of EDITS = 8 % (none under 16 bytes) and q = 8 the bound is positive from LEAST = 8 bytes on, hence no match
within the budget is missed. Matches of items without edit budget must start and end at word borders."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, text_slices, tidy

Q, WINDOW, EDITS, LEAST = 8, 160, 0.08, 8
FINE = 4
#: Patterns of fewer bytes must match exactly, on word borders.
EXACT = 16
BAND = 32
#: Bytes of normalised benchmark text that are searched for at a time. A task has one block in memory, about 40 bytes a byte of it.
BLOCK_BYTES = 2 << 20
#: Longer documents are searched in overlapping parts of this many bytes.
PART = 1 << 20
#: Patterns that a q-gram may be part of before it counts as hot.
HOT = 16
#: Shared q-grams and alignment cells that are held at a time.
EXPANDED, CELLS = 1 << 20, 1 << 21
#: The usual marks; rarer ones are told by their class.
_MARKS = re.compile("[̀-͎͐-ͯ]+")
#: ASCII characters but letters and digits, as spaces.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normalise(text: str) -> bytes:
    """The text as it is compared: NFKD without marks, case folded, other characters as one space."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))
        if not text.isascii():
            text = "".join(c if c.isalnum() else " " for c in text if not unicodedata.combining(c))
    return b" ".join(text.lower().encode("utf-8", "ignore").translate(_PLAIN).split())


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each place, exactly, as an integer of its 8 bytes."""
    out = np.empty(max(0, len(data) - Q + 1), np.uint64)
    raw = data.tobytes()
    for first in range(min(Q, len(out))):
        count = (len(raw) - first) // Q
        out[first::Q] = np.frombuffer(raw, np.uint64, count, first)[: len(out[first::Q])]
    return out


def _fine(data: bytes) -> np.ndarray:
    """16-bit hashes of the FINE-grams at each place."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    value = raw[: len(raw) - FINE + 1].copy()
    for i in range(1, FINE):
        value = value * np.uint32(0x9E3779B1) + raw[i : len(raw) - FINE + 1 + i]
    return ((value * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … (sizes[0] of them), starts[1], …"""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


@dataclass
class Patterns:
    texts: list[bytes]
    owners: list[list[tuple[int, int]]]  # of each pattern: its items, and its number among each item's patterns
    grams: np.ndarray  # q-grams of all patterns, by place
    bounds: np.ndarray  # of each pattern's q-grams
    budget: np.ndarray
    bound: np.ndarray
    fine: np.ndarray  # FINE-grams of all patterns
    left_out: np.ndarray  # hot q-grams that are not looked up
    keys: np.ndarray  # distinct q-grams that are looked up, sorted
    first: np.ndarray  # bounds of each one's occurrences
    pattern: np.ndarray  # of each occurrence: the pattern and the place in it
    place: np.ndarray
    filter: np.ndarray
    bits: int

    @staticmethod
    def of(items: list[tuple[int, bytes]]) -> Patterns:
        owners: dict[bytes, list[tuple[int, int]]] = {}
        for item, text in items:
            last = max(0, len(text) - WINDOW)
            for n, start in enumerate([*range(0, last, WINDOW // 2), last] if len(text) >= LEAST else ()):
                owners.setdefault(text[start : start + WINDOW], []).append((item, n))
        texts = list(owners)
        lengths = np.array([len(t) for t in texts], np.int64)
        budget = np.where(lengths < EXACT, 0, (EDITS * lengths).astype(np.int64))
        every = np.concatenate([grams(np.frombuffer(t, np.uint8)) for t in texts] or [np.zeros(0, np.uint64)])
        sizes = lengths - Q + 1
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        pattern = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(every)) - np.repeat(bounds[:-1], sizes)
        bound = lengths + 1 - (budget + 1) * Q
        _, kind = np.unique(every, return_inverse=True)
        held_by = np.bincount(np.unique(kind * len(texts) + pattern) // max(1, len(texts)), minlength=1)[kind] if len(kind) else kind
        hot = np.flatnonzero(held_by > HOT)
        hot = hot[np.lexsort((-held_by[hot], pattern[hot]))]  # of each pattern, the hottest first
        size = np.bincount(pattern[hot], minlength=len(texts))
        hot = hot[np.arange(len(hot)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(bound - 1, size)]
        looked_up = np.ones(len(every), bool)
        looked_up[hot] = False
        seed = np.flatnonzero(looked_up)
        seed = seed[np.argsort(every[seed], kind="stable")]
        keys, first = np.unique(every[seed], return_index=True)
        bits = int(np.clip(len(keys).bit_length() + 4, 16, 26))
        held = np.zeros(1 << bits, bool)
        held[_slot(keys, bits)] = True
        left_out = np.bincount(pattern[hot], minlength=len(texts))
        return Patterns(texts, list(owners.values()), every, bounds, budget, bound, np.concatenate([_fine(t) for t in texts] or [np.zeros(0, np.uint16)]), left_out, keys, np.append(first, len(seed)), pattern[seed].astype(np.int32), place[seed].astype(np.int16), held, bits)


def distances(patterns: list[bytes], texts: list[bytes], budgets: list[int]) -> np.ndarray:
    """For each, the least edits between the pattern and any part of the text, or budget + 1 if there are more.

    Rows of like size are aligned together. Cells are held by diagonal: diagonal d of step i is text place i + d - budget, and
    step 0 is free anywhere in the text, so each step is a few array operations on the bands of all rows."""
    out = np.array(budgets, np.int64) + 1
    width = np.array([len(t) - len(p) + 2 * k + 1 for p, t, k in zip(patterns, texts, budgets, strict=True)])
    order = np.lexsort((width, [len(p) for p in patterns]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (width[order[to]] + 2 * WINDOW) <= CELLS:
            to += 1
        rows, at = order[at:to], to
        rows = rows[width[rows] >= 1]
        if len(rows):
            out[rows] = np.minimum(out[rows], _aligned([patterns[r] for r in rows], [texts[r] for r in rows], np.array([budgets[r] for r in rows])))
    return out


def _aligned(patterns: list[bytes], texts: list[bytes], budget: np.ndarray) -> np.ndarray:
    size, ends = np.array([len(p) for p in patterns]), np.array([len(t) for t in texts])
    width, most = int((ends - size + 2 * budget + 1).max()), int(size.max())
    # 256 and 257 are no bytes and equal nothing. What is read outside a text costs as much as leaving the pattern's byte out, so
    # no place needs to be excluded. Text place x of row r is column x + budget, so that cell d of step i reads column i - 1 + d.
    letters = np.full((len(size), most), 257, np.int16)
    read = np.full((len(size), max(most + width, int((ends + budget).max()))), 256, np.int16)
    for r, (p, t) in enumerate(zip(patterns, texts, strict=True)):
        letters[r, : len(p)] = np.frombuffer(p, np.uint8)
        read[r, budget[r] : budget[r] + len(t)] = np.frombuffer(t, np.uint8)
    ramp = np.arange(width, dtype=np.int16)
    before = np.zeros((len(size), width), np.int16)
    out = np.full(len(size), 1 << 14)
    live = np.arange(len(size))
    for i in range(most):
        now = before + (read[:, i : i + width] != letters[:, i, None])
        np.minimum(now[:, :-1], before[:, 1:] + 1, out=now[:, :-1])
        now -= ramp
        np.minimum.accumulate(now, axis=1, out=now)
        now += ramp
        if i % 4 == 3 or i + 1 == most or (size[live] == i + 1).any():
            least = now.min(1)
            done = size[live] == i + 1
            out[live[done]] = least[done]
            go = ~done & (least <= budget[live])
            if not go.all():
                live, now, read, letters = live[go], now[go], read[go], letters[go]
                if not len(live):
                    break
        before = now
    return out


def distance(pattern: np.ndarray, text: np.ndarray, budget: int) -> int:
    """`distances` of one pair."""
    return int(distances([pattern.tobytes()], [text.tobytes()], [budget])[0])


def _counted(pattern: np.ndarray, place: np.ndarray, at: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(pattern << 32 | band, places of the pattern that have their q-gram on a diagonal of the band) for q-grams at text places `at`.

    Band b holds the diagonals from b * BAND to (b + 1) * BAND + 2 * budget. A place counts once, however often its q-gram
    repeats within the band."""
    diagonal = at - place + WINDOW
    top = diagonal // BAND
    low = np.maximum(0, -(-(diagonal - 2 * patterns.budget[pattern] - BAND) // BAND))
    size = top - low + 1
    both = (pattern.astype(np.int64) << 40) | (place.astype(np.int64))
    once = np.sort(np.repeat(both, size) | (_spread(low, size) << 8))
    once = once[np.append(True, once[1:] != once[:-1])] >> 8
    starts = np.flatnonzero(np.append(True, once[1:] != once[:-1]))
    return once[starts], np.diff(np.append(starts, len(once)))


def _retained(keys: np.ndarray, wanted: np.ndarray, patterns: Patterns) -> Iterator[int]:
    """Those of the bands `wanted` that reach the bound with all q-grams of their patterns."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    names = np.unique(wanted >> 32)
    for part in np.array_split(names, len(names) // 4096 + 1):
        sizes = np.diff(patterns.bounds)[part]
        own = _spread(patterns.bounds[part], sizes)
        place = own - np.repeat(patterns.bounds[part], sizes)
        lo = np.searchsorted(ranked, patterns.grams[own], "left")
        count = np.searchsorted(ranked, patterns.grams[own], "right") - lo
        ends = np.cumsum(count)[np.cumsum(sizes) - 1]
        for some in np.unique(ends // EXPANDED):  # whole patterns, about EXPANDED shared q-grams at a time
            chosen = np.repeat(ends // EXPANDED == some, sizes)
            n = count[chosen]
            if not n.any():
                continue
            band, places = _counted(np.repeat(np.repeat(part, sizes)[chosen], n), np.repeat(place[chosen], n), order[_spread(lo[chosen], n)], patterns)
            good = places >= patterns.bound[band >> 32]
            yield from np.intersect1d(band[good], wanted, assume_unique=True).tolist()


def _plausible(pairs: list[tuple[int, bytes]], patterns: Patterns) -> list[tuple[int, bytes]]:
    """Those of the pairs (pattern, region) in which the region has as many FINE-grams of the pattern as a match within the budget must have."""
    out, held = [], np.zeros(1 << 16, bool)
    for region, group in itertools.groupby(sorted(pairs, key=lambda x: x[1]), key=lambda x: x[1]):
        names = np.array([p for p, _ in group])
        own = _fine(region)
        held[own] = True
        starts = patterns.bounds[names] + names * (Q - FINE)  # each pattern has Q - FINE more of them than q-grams
        sizes = np.diff(patterns.bounds)[names] + Q - FINE
        hits = np.add.reduceat(held[patterns.fine[_spread(starts, sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
        held[own] = False
        out += [(p, region) for p in names[hits >= sizes - patterns.budget[names] * FINE].tolist()]
    return out


def search(data: bytes, patterns: Patterns) -> list[tuple[int, int, int]]:
    """(pattern, edits, place of the region) of the patterns that the normalised text holds within their budgets."""
    keys = grams(np.frombuffer(data, np.uint8))
    maybe = np.flatnonzero(patterns.filter[_slot(keys, patterns.bits)])
    if not len(maybe) or not len(patterns.keys):
        return []
    at = np.searchsorted(patterns.keys, keys[maybe])
    at[at == len(patterns.keys)] = 0
    good = patterns.keys[at] == keys[maybe]
    maybe, at = maybe[good], at[good]
    sizes = patterns.first[at + 1] - patterns.first[at]
    if not len(sizes):
        return []
    if sizes.sum() > EXPANDED and len(data) > 8 * WINDOW:  # halves, with room for a match
        first, last = _at_space(data, len(data) // 2 - WINDOW), _at_space(data, len(data) // 2 + 2 * WINDOW)
        both = search(data[:last], patterns) + [(p, e, first + place) for p, e, place in search(data[first:], patterns)]
        best: dict[int, tuple[int, int]] = {}
        for p, e, place in both:
            best[p] = min(best.get(p, (e, place)), (e, place))
        return [(p, e, place) for p, (e, place) in best.items()]
    seed = _spread(patterns.first[at], sizes)
    band, places = _counted(patterns.pattern[seed], patterns.place[seed], np.repeat(maybe, sizes), patterns)
    owner = band >> 32
    good = places >= patterns.bound[owner] - patterns.left_out[owner]
    band, again = band[good], patterns.left_out[owner[good]] > 0
    if not len(band):
        return []
    kept = band[~again].tolist()
    if again.any():
        kept += _retained(keys, band[again], patterns)
    found: dict[int, tuple[int, int]] = {}
    close: dict[tuple[int, bytes], int] = {}  # regions that hold the pattern not exactly, with their first place
    for key in kept:
        p, b = key >> 32, key & 0xFFFFFFFF
        if found.get(p, (1, 0))[0] == 0:
            continue
        k, w = int(patterns.budget[p]), patterns.texts[p]
        lo = max(0, b * BAND - WINDOW - k)
        region = data[lo : b * BAND - WINDOW + BAND + 2 * k + len(w) + k]
        place = _whole_words(data, w, lo, lo + len(region)) if len(w) < EXACT else data.find(w, lo, lo + len(region))
        if place >= 0:
            found[p] = (0, place)
        elif k:
            close[p, region] = min(lo, close.get((p, region), lo))
    left = _plausible([x for x in close if x[0] not in found], patterns)
    edits = distances([patterns.texts[p] for p, _ in left], [r for _, r in left], [int(patterns.budget[p]) for p, _ in left])
    for (p, region), e in zip(left, edits.tolist(), strict=True):
        if e <= patterns.budget[p]:
            lo = close[p, region]
            found[p] = min(found.get(p, (e, lo)), (e, lo))
    return [(p, e, place) for p, (e, place) in found.items()]


def _whole_words(data: bytes, pattern: bytes, lo: int, hi: int) -> int:
    """The first place of the pattern in data[lo:hi] with a space or an end on both sides, or -1."""
    at = data.find(pattern, lo, hi)
    while at >= 0:
        end = at + len(pattern)
        if data[max(0, at - 1) : at] in (b" ", b"") and data[end : end + 1] in (b" ", b""):
            return at
        at = data.find(pattern, at + 1, hi)
    return -1


def _at_space(data: bytes, at: int) -> int:
    """Where a text may be cut at or a little after a place: behind a space, or right there in a very long word."""
    space = data.find(b" ", at, at + WINDOW)
    return space + 1 if space >= 0 else at


def _parts(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while len(data) - at > PART + 4 * WINDOW:
        last = _at_space(data, at + PART)
        yield at, data[at:last]
        at = _at_space(data, last - 4 * WINDOW)
    yield at, data[at:]


_MATCH = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "pattern", "edits", "place")]))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with a column matches: array<struct<item_id, pattern, edits, place>> of the patterns that the text holds, in this order.

    pattern numbers the item's patterns, place is in bytes of the normalised text. Null and empty documents, and items that are null
    or have fewer than LEAST normalised bytes (about a word), match nothing. A column of that name is replaced; all others and repeated rows
    stay. The benchmark is compiled in blocks of BLOCK_BYTES, each broadcast. A task normalises its texts once and has one block in
    memory at a time; no pair of a document and an item is formed unless they share q-grams in a band."""
    docs = docs.drop("matches")
    at = docs.columns.index(text_col)
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(Patterns.of(block)) for block in _blocks(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")))]

    def run(batches):
        for batch in batches:
            rows = [(lo, [normalise(t) if t else b"" for t in batch.column(at).slice(lo, hi - lo).to_pylist()]) for lo, hi in text_slices(batch.column(at))]
            found: list[dict[tuple[int, int], tuple[int, int]]] = [{} for _ in range(batch.num_rows)]
            for block in sent:
                patterns = block.value
                for lo, texts in rows:
                    for own, text in zip(found[lo : lo + len(texts)], texts, strict=True):
                        for start, data in _parts(text):
                            for p, edits, place in search(data, patterns):
                                for key in patterns.owners[p]:
                                    own[key] = min(own.get(key, (edits, start + place)), (edits, start + place))
                if len(sent) > 1:  # else a worker would keep every block
                    del patterns
                    block.__dict__.pop("_value", None)
            matches = [[dict(item_id=i, pattern=p, edits=e, place=x) for (i, p), (e, x) in sorted(own.items())] for own in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(matches, _ARROW)], [*batch.schema.names, "matches"])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("matches", _MATCH)]))


_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "pattern", "edits", "place")]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names: str) -> DataFrame:
    """Matches of benchmark passages: (doc_id, item_id, n_patterns, edits, place), one row for each document and item.

    n_patterns counts the item's patterns that the document holds, edits and place are those of the closest.
    Rows that repeat an id give one row with the best of them; rows without an id are left out."""
    ids = [F.col(id_col).cast("long").alias("doc_id"), F.col(names.get("text_col", "text")).alias("text")]
    found = benchmark_matches(docs.select(*ids).where("doc_id is not null"), benchmark, **names | {"text_col": "text"})
    each = found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    best = F.min(F.struct("edits", "place"))
    return each.groupBy("doc_id", "item_id").agg(F.count_distinct("pattern").alias("n_patterns"), best.alias("best")).select("doc_id", "item_id", "n_patterns", F.col("best.edits").alias("edits"), F.col("best.place").alias("place"))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    block, held = [], 0
    for row in benchmark.where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        text = normalise(row.text)
        block.append((row.item_id, text))
        held += len(text)
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
