"""Operator 12: SentencePiece encoding that keeps the place of every piece in the original bytes, and decoding.

A text is normalised by the longest prefix that the model's compiled character map knows (a double-array trie over
bytes); what it doesn't know is copied, character by character. For every character of the normalised text the source's
byte offset is kept, so each piece, whatever became of its characters, is projected to a span of original bytes.
Normalised texts are cut before each run of space marks, which no piece reaches over, and each different cut is merged once
a worker: the best-scored neighbours first, the leftmost of equal ones. Characters without a piece become byte pieces;
only the last of them has the character's span, as in the library."""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, text_slices, tidy

SPACE = "▁"
#: Cuts that a worker remembers, and pieces in them.
REMEMBERED, REMEMBERED_PIECES = 250_000, 2_000_000
#: Longer texts are encoded in parts of about so many characters.
PART = 1 << 19
#: Cuts up to this length are merged together, longer ones by a heap.
SHORT = 48
_NEVER = np.iinfo(np.int32).max
_CUTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_ACROSS = re.compile(f"[^{SPACE}]{SPACE}")
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class CharacterMap:
    """The compiled map of a model: replacements by the longest known prefix of bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = array("I", blob[4 : 4 + size] or bytes(1024))  # without rules, a root that leads nowhere
        self.targets = blob[4 + size :]

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """(end, replacement) of the longest prefix of data[at:] in the map."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                found = i + 1, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end, start = found
        return end, self.targets[start : self.targets.index(b"\0", start)].decode()

    def spans(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(normalised string, source start, source end) from left to right; offsets in bytes."""
        data, at = text.encode(), 0
        while at < len(data):
            if found := self.longest(data, at):
                end, out = found
            else:
                lead = data[at]
                end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
                out = data[at:end].decode()
            yield out, at, end
            at = end


_NO_MAP = CharacterMap(b"")


class _Numbers(dict):
    """Numbers by first use; `fresh` has the keys that are new."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number


class PairTable:
    """What two neighbouring pieces make, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        both = np.array(list(pairs), np.int64).reshape(-1, 2)
        keys, values = both[:, 0] << 32 | both[:, 1], np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = free & (self.keys[at] == keys)
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, its rank in `order`) for each pair; _NEVER where there is none. A negative piece is no piece."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._home(keys)
        made, rank = np.zeros(len(keys), np.int32), np.full(len(keys), _NEVER, np.int32)
        open_ = np.flatnonzero(keys >= 0)
        while len(open_):
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            made[open_[hit]] = self.values[at[open_[hit]]]
            rank[open_[hit]] = order[made[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return made, rank


class Pieces:
    """Encoder and decoder of a BPE model of the sentencepiece library."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix or not set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or not spec.escape_whitespaces:
            raise ValueError("only BPE models with space marks before words and without own symbols are known")
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.vocabulary = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown, self.end = kinds.index(_UNKNOWN), next((i for i, p in enumerate(model.pieces) if p.piece == trainer.eos_piece), None)
        self.kinds = np.array(kinds)
        self.order = np.unique(np.array([-p.score for p in model.pieces], np.float32), return_inverse=True)[1].astype(np.int32)
        self.size = np.array([len(p.piece) for p in model.pieces], np.int32)
        known = self.vocabulary
        self.letters = np.full(0x110000, -1, np.int32)
        for piece, i in known.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = i
        self.spelled: list[list[int]] = []
        self.closed = all(self.letters[ord(c)] >= 0 for c in set("".join(known)))  # no piece has a character without one
        self.pairs = PairTable({(known[p[:i]], known[p[i:]]): k for p, k in known.items() for i in range(1, len(p)) if p[:i] in known and p[i:] in known})
        self.unit = not any(_ACROSS.search(p) for p in self.vocabulary)
        label = {_CONTROL: lambda p: b"", _UNKNOWN: lambda p: trainer.unk_surface.encode(), _BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        self.labels = np.array([label.get(p.type, lambda p: p.replace(SPACE, " ").encode())(p.piece) for p in model.pieces], object)
        self.forget()

    def forget(self) -> None:
        """Drop the remembered cuts."""
        self.index = _Numbers()
        self.ids, self.lengths, self.bounds = array("i"), array("i"), array("q", [0])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters, and its end, the source's byte offset."""
        if not self.map and not self.squeeze:
            if text.isascii():
                at = np.arange(len(text) + 1, dtype=np.int32)
            else:
                data = np.frombuffer(text.encode(), np.uint8)
                at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int32)
            out = text.replace(" ", SPACE)
            return (SPACE + out, np.concatenate((at[:1], at))) if self.prefix and text else (out, at)
        parts, places, end = [], [], 0
        begun, spaced = False, self.squeeze
        for out, start, stop in (self.map or _NO_MAP).spans(text):
            if not begun:
                if self.squeeze and out == " ":
                    continue  # white space before the text
                begun = True
                if self.prefix:
                    parts.append(SPACE)
                    places.append(start)
            out = out.lstrip(" ") if spaced else out
            if out:
                parts.append(out.replace(" ", SPACE))
                places += [start] * len(out)
                spaced = self.squeeze and out.endswith(" ")
            end = stop
        if self.squeeze:  # white space behind it
            while parts and parts[-1].endswith(SPACE):
                kept = parts[-1].rstrip(SPACE)
                end = places[len(places) - len(parts[-1]) + len(kept)]
                places = places[: len(places) - len(parts[-1]) + len(kept)]
                parts[-1:] = [kept] if kept else []
        return "".join(parts), np.array([*places, end], np.int32)

    def _merged(self, cut: str) -> Iterator[str]:
        """The pieces of one cut of any length."""
        rank, parts, n = self.rank.get, list(cut), len(cut)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(score, i, i + 1, 2) for i in range(n - 1) if (score := rank(cut[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if right[a] != b or not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue  # one of the two has been merged since
            parts[a] += parts[b]
            parts[b] = ""
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            for x, y in ((left[a], a), (a, right[a])):
                if x >= 0 and y < n and (score := rank(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (score, x, y, len(parts[x]) + len(parts[y])))
        return filter(None, parts)

    def _one(self, cut: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths in characters) of one cut."""
        ids, lengths = [], []
        for piece in self._merged(cut):
            if (found := self.vocabulary.get(piece)) is not None:
                ids.append(found)
                lengths.append(len(piece))
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode()]
                lengths += [0] * (len(ids) - len(lengths) - 1) + [1]
            elif ids and ids[-1] == self.unknown:  # unknown neighbours are one piece
                lengths[-1] += len(piece)
            else:
                ids.append(self.unknown)
                lengths.append(len(piece))
        return np.array(ids, np.int32), np.array(lengths, np.int32)

    def _many(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many each has) of cuts that hold only characters with a piece: the best pair of every cut is merged at once.

        `chars` has the characters' ids, one cut after another, `sizes` the cuts' lengths."""
        m, width = len(sizes), int(sizes.max())
        token = np.full((m, width + 2), -1, np.int32)  # a free column on either side
        token[:, 1:-1][np.arange(width) < sizes[:, None]] = chars
        before = np.tile(np.arange(-1, width + 1, dtype=np.int32), (m, 1))
        behind = before + 2
        made, rank = self.pairs.find(token[:, :-1].ravel(), token[:, 1:].ravel(), self.order)
        made, rank = made.reshape(m, -1), rank.reshape(m, -1)
        rows = np.arange(m)
        while len(rows):
            at = rank[rows].argmin(1)
            open_ = rank[rows, at] != _NEVER
            rows, at = rows[open_], at[open_]
            gone = behind[rows, at]
            after, ahead = behind[rows, gone], before[rows, at]
            token[rows, at] = new = made[rows, at]
            token[rows, gone] = -1
            rank[rows, np.minimum(gone, width)] = _NEVER
            behind[rows, at] = after
            before[rows, after] = at
            made[rows, at], rank[rows, at] = self.pairs.find(new, token[rows, after], self.order)
            made[rows, ahead], rank[rows, ahead] = self.pairs.find(token[rows, ahead], new, self.order)
        alive = token >= 0
        return token[alive], alive.sum(1)

    def _learn(self, cuts: list[str]) -> None:
        """Ids and lengths of new cuts, kept in their order."""
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        points = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = self.letters[points]
        if self.bytes:  # a character without a piece has a number of its own until it becomes byte pieces
            for point in np.unique(points[chars < 0]).tolist():
                self.letters[point] = len(self.kinds) + len(self.spelled)
                self.spelled.append([self.bytes[b] for b in chr(point).encode()])
            chars = self.letters[points]
        starts = np.cumsum(size) - size
        plain = (np.minimum.reduceat(chars, starts) >= 0) & (size <= SHORT) & self.closed
        counts, own, found = np.zeros(len(cuts), np.int64), {}, []
        low = 0
        for high in (8, 16, SHORT):
            group = np.flatnonzero(plain & (size > low) & (size <= high))
            for some in np.array_split(group, len(group) // 20_000 + 1) if len(group) else ():
                inside = np.repeat(starts[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
                tokens, counts[some] = self._many(chars[inside], size[some])
                found.append((some, tokens))
            low = high
        for i in np.flatnonzero(~plain).tolist():
            own[i] = self._one(cuts[i])
            counts[i] = len(own[i][0])
        stops = np.cumsum(counts)
        ids = np.zeros(counts.sum(), np.int32)
        for some, values in found:
            ids[np.repeat(stops[some] - np.cumsum(counts[some]), counts[some]) + np.arange(len(values))] = values
        spelled = ids >= len(self.kinds)
        lengths = self.size[np.where(spelled, 0, ids)]
        for i, values in own.items():
            ids[stops[i] - counts[i] : stops[i]], lengths[stops[i] - counts[i] : stops[i]] = values
        if spelled.any():
            width = np.ones(len(ids), np.int64)
            width[spelled] = [len(self.spelled[i]) for i in ids[spelled] - len(self.kinds)]
            last = np.cumsum(width)
            stops = last[stops - 1]
            wide = np.zeros(last[-1], np.int32)
            wide[last - 1] = np.where(spelled, 1, lengths)
            lengths, ids = wide, np.repeat(ids, width)
            ids[ids >= len(self.kinds)] = np.concatenate([self.spelled[i] for i in ids[last - 1][spelled] - len(self.kinds)])
        self.bounds.frombytes((stops + self.bounds[-1]).tobytes())
        self.ids.frombytes(ids.tobytes())
        self.lengths.frombytes(lengths.tobytes())

    def _parts(self, text: str) -> Iterator[str]:
        """Stretches of a normalised text that end where a cut ends."""
        at = 0
        while at < len(text):
            found = _ACROSS.search(text, at + PART) if len(text) - at > 2 * PART and self.unit else None
            end = found.start() + 1 if found else len(text)
            yield text[at:end]
            at = end

    def _flat(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, lengths in characters) of each stretch; what is new in them is learned together."""
        if len(self.index) > REMEMBERED or len(self.ids) > REMEMBERED_PIECES:
            self.forget()
        number = self.index.__getitem__
        places = [np.fromiter(map(number, cuts), np.int64, len(cuts)) for cuts in (_CUTS.findall(p) if self.unit else [p] for p in parts)]
        if self.index.fresh:
            self._learn(self.index.fresh)
            self.index.fresh = []
        bounds, ids, lengths = np.array(self.bounds), np.array(self.ids), np.array(self.lengths)
        out = []
        for at in places:
            sizes = bounds[at + 1] - bounds[at]
            stops = np.cumsum(sizes)
            flat = np.arange(stops[-1]) + np.repeat(bounds[at] - stops + sizes, sizes)
            out.append((ids[flat], lengths[flat]))
        return out

    def encode(self, texts: list[str | None], end: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first bytes, bytes behind the last) of the pieces of each text; `end` adds the end id, at the text's end."""
        places, found, waiting, held = [], [[] for _ in texts], [], 0
        for row, text in enumerate(texts):
            norm, at = self.normalise(text or "")
            places.append(at)
            for part in self._parts(norm):
                waiting.append((row, part))
                held += len(part)
                if held >= 2 * PART:
                    for (r, _), x in zip(waiting, self._flat([p for _, p in waiting]), strict=True):
                        found[r].append(x)
                    waiting, held = [], 0
        for (r, _), x in zip(waiting, self._flat([p for _, p in waiting]), strict=True):
            found[r].append(x)
        none = np.zeros(0, np.int32)
        out = []
        for text, at, parts in zip(texts, places, found, strict=True):
            ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0] if parts else (none, none)
            stops = np.cumsum(lengths)
            begins, ends = at[stops - lengths], at[stops]
            if end and self.end is not None:
                size = np.int32(len(text.encode()) if text and not text.isascii() else len(text or ""))
                ids, begins, ends = np.append(ids, np.int32(self.end)), np.append(begins, size), np.append(ends, size)
            out.append((ids, begins, ends))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for. Bytes that are no UTF-8 become U+FFFD each; ids outside the vocabulary are a ValueError."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.labels)):
            raise ValueError("no such piece")
        kinds = self.kinds[ids]
        own = kinds != _CONTROL
        ids, kinds, breaks = ids[own], kinds[own], np.cumsum(~own)[own]
        labels = self.labels[ids]
        if self.prefix or self.squeeze:
            for i in range(len(labels)):
                if kinds[i] == _NORMAL and labels[i][:1] == b" ":
                    labels[i] = labels[i][1:]
                    if self.squeeze and not labels[i]:
                        continue
                break
        if not (kinds == _BYTE).any():
            return b"".join(labels).decode()
        # runs of byte pieces are read on their own, whatever stands beside them
        edges = np.flatnonzero(((kinds == _BYTE)[1:] != (kinds == _BYTE)[:-1]) | (breaks[1:] != breaks[:-1])) + 1
        out = []
        for a, b in zip([0, *edges], [*edges, len(ids)], strict=True):
            run = b"".join(labels[a:b])
            try:
                out.append(run.decode())
            except UnicodeDecodeError:
                out.append(_each_byte(run))
        return "".join(out)


def _each_byte(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        at += n
    return "".join(out)


_loaded: dict[str, Pieces] = {}


def _pieces(name: str) -> Pieces:
    """The worker's copy of a model that ``addFile`` has sent to every executor."""
    if name not in _loaded:
        with open(SparkFiles.get(name), "rb") as f:
            _loaded[name] = Pieces(f.read())
    return _loaded[name]


_IDS = T.ArrayType(T.IntegerType())
_COLUMNS = {"ids": _IDS, "begins": _IDS, "ends": _IDS, "decoded": T.StringType()}


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    stops = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int32()))


def _encoded(docs: DataFrame, model_file: str, text_col: str, end: bool, columns: tuple[str, ...], keep_text: bool) -> DataFrame:
    docs.sparkSession.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]
    rest = [c for c in docs.columns if c.lower() not in columns and (keep_text or c.lower() != text_col.lower())]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").alias("text to encode"))

    def run(batches):
        pieces = _pieces(name)
        for batch in batches:
            for lo, hi in text_slices(batch.column(len(rest))):
                part = batch.slice(lo, hi - lo)
                found = pieces.encode(part.column(len(rest)).to_pylist(), end)
                made = {c: _lists([x[i] for x in found]) for i, c in enumerate(("ids", "begins", "ends")) if c in columns}
                if "decoded" in columns:
                    made["decoded"] = pa.array([pieces.decode(x[0]) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(made[c] for c in columns)], [*rest, *columns])
        pieces.forget()

    schema = T.StructType([*docs.schema.fields[:-1], *(T.StructField(c, _COLUMNS[c]) for c in columns)])
    return docs.mapInArrow(tidy(run), schema)


def piece_encode(docs: DataFrame, model_file: str, text_col: str = "text", end: bool = True) -> DataFrame:
    """`docs` with ids, begins and ends (arrays of int): each piece's id and its span in the bytes of the original text.

    `end` adds the end id, with an empty span at the text's end. A null text counts as empty and has no piece but that. Columns of these names
    are replaced, all others and repeated rows stay. A text is encoded in parts of about PART characters, so a task's
    memory is bounded by the longest text and a batch; a text without any space is one part."""
    return _encoded(docs, model_file, text_col, end, ("ids", "begins", "ends"), True)


def piece_round_trip(docs: DataFrame, model_file: str, text_col: str = "text", end: bool = True) -> DataFrame:
    """`docs` without `text_col`, with ids, begins and ends as piece_encode gives them and decoded, the text that the ids stand for, in one pass."""
    return _encoded(docs, model_file, text_col, end, ("ids", "begins", "ends", "decoded"), False)


def piece_decode(docs: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`docs` with `out_col`, the text that the ids of `ids_col` stand for: null for null ids, empty for an empty list."""
    docs.sparkSession.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]
    docs = docs.drop(out_col)
    at = docs.columns.index(ids_col)

    def run(batches):
        pieces = _pieces(name)
        for batch in batches:
            text = [None if ids is None else pieces.decode(np.array(ids, np.int64)) for ids in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, out_col])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType())]))


def op12_sentencepiece_encode_decode(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    back = piece_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), model_file)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
