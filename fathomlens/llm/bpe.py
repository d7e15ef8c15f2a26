"""Operator 9: byte-pair encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state in which every base symbol
leads back to it; the merges are then applied in order. The gadget of merge
(a, b) -> ab adds one state, a copy of the state where the a arcs lead, without
its b arc; all a arcs are turned to the copy, and every state with an a arc gets an arc
ab that leads where b leads. What it accepts then are exactly the token sequences
that the merges make of their own text, so the encoding of a word is the only
accepted path that spells it. Arcs with one label lead to one state, which keeps the
automaton at one state for each merge: a state stores its parent, the removed label and
the merge's number, and its row of the transition table is filled when first used.

Encoding walks the table over a word, longest arc first, and turns back from
dead ends (remembered by place and state). Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, text_slices, tidy

#: Words whose ids a worker remembers.
REMEMBERED = 250_000
#: Longer texts are encoded in parts of about so many characters, cut at white space.
PART = 1 << 19
_END = "\x00"  # stands for the end-of-word mark inside the automaton
_WHITE = "\t-\r \x85\xa0  -     　"
_LATIN_LETTER, _LATIN_NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d|"
_SPLIT_LATIN = re.compile(f"{_SHORT}[{_LATIN_LETTER}]+|[{_LATIN_NUMBER}]|[^{_WHITE}{_LATIN_LETTER}{_LATIN_NUMBER}]+")
_SPLIT = regex.compile(rf"{_SHORT}\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
_CUT = re.compile("[ \n\t]")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """Deterministic automaton over token labels, compiled from ordered merges."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        self.number = {label: i for i, label in enumerate(base)}
        self.label = list(base)
        self.left = [-1] * len(base)
        self.made = [0] * len(base)
        self.parent, self.removed, self.time = [-1], [-1], [0]
        self.target = [0] * len(base)
        self.gone: dict[int, dict[int, int]] = {0: {}}
        self.row: dict[int, dict[int, int]] = {}
        never: set[str] = set()  # labels whose pair never meets
        for time, (a, b) in enumerate(merges, 1):
            if a + b in self.number or a + b in never:
                raise ValueError(f"two merges make {a + b!r}")
            if a in never or b in never or not self._gadget(self.number[a], self.number[b], time):
                never.add(a + b)
        self.reach: dict[str, int] = {}  # the longest label with these first three characters
        for label in self.label:
            if len(label) > 2:
                self.reach[label[:3]] = max(self.reach.get(label[:3], 0), len(label))
        self.gone = {0: {}}

    def _gadget(self, a: int, b: int, time: int) -> bool:
        """Apply one merge; False, and no change, where the pair never meets."""
        before, ahead = self.target[a], self.target[b]
        if not self._has(before, b):
            return False
        self.parent.append(before)
        self.removed.append(b)
        self.time.append(time)
        self.target[a] = len(self.parent) - 1
        label = self.label[a] + self.label[b]
        self.number[label] = len(self.label)
        self.label.append(label)
        self.left.append(a)
        self.made.append(time)
        self.target.append(ahead)
        return True

    def _removals(self, state: int) -> dict[int, int]:
        """label -> first merge that took it away, over the state and those it was copied from."""
        if (found := self.gone.get(state)) is None:
            chain = []
            at = state
            while at > 0:
                chain.append(at)
                at = self.parent[at]
            found = {self.removed[s]: self.time[s] for s in chain}  # the oldest comes last and wins
            if len(self.gone) > 20_000:
                self.gone.clear()
            self.gone[state] = found
        return found

    def _has(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token: it got one with the token's merge if it then had one for its left part."""
        gone, until = self._removals(state), 1 << 60
        while token >= 0:
            if gone.get(token, 1 << 61) <= until:  # equal: the merge of a label with itself
                return False
            until, token = self.made[token], self.left[token]
        return True

    def step(self, state: int, token: int) -> int:
        """The state that the token leads to, or -1."""
        row = self.row.get(state)
        if row is None:
            if len(self.row) > 50_000:
                self.row.clear()
            row = self.row[state] = {}
        to = row.get(token)
        if to is None:
            to = row[token] = self.target[token] if self._has(state, token) else -1
        return to

    def path(self, word: str) -> list[int]:
        """The token numbers of the accepted path that spells the word."""
        find, step, n, reach = self.number.get, self.step, len(word), self.reach.get
        rows = self.row
        at, state, length = 0, 0, min(n, reach(word[:3], 2))
        taken: list[tuple[int, int, int]] = []  # place, state and arc length, to turn back to
        tokens: list[int] = []
        dead: set[tuple[int, int]] = set()
        while at < n:
            row = rows.get(state) or {}
            while length:
                token = find(word[at : at + length])
                if token is not None:
                    to = row.get(token)
                    if to is None:
                        to = step(state, token)
                    if to >= 0 and (not dead or (at + length, to) not in dead):
                        break
                length -= 1
            if length:
                taken.append((at, state, length))
                tokens.append(token)
                at += length
                state = to
                length = reach(word[at : at + 3], 2)
                if length > n - at:
                    length = n - at
                continue
            dead.add((at, state))
            if not taken:
                raise ValueError(f"no token spells {word!r}")
            at, state, length = taken.pop()
            tokens.pop()
            length -= 1
        return tokens


class Encoder:
    """A lower-casing word BPE with end-of-word marks, read from its vocabulary file's JSON."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        self.mark = mark
        short = lambda s: s[: -len(mark)] + _END if s.endswith(mark) else s
        letters = _byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = MergeAutomaton([*letters, *(x + _END for x in letters)], [(short(a), short(b)) for a, b in merges])
        vocabulary = model["vocab"]
        self.ids = [vocabulary[x[:-1] + mark if x[-1] == _END else x] for x in self.automaton.label]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        labels = {i: s for s, i in vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.labels = [labels.get(i) for i in range(max(labels) + 1)]
        self.letters = str.maketrans({chr(b): x for b, x in enumerate(letters)})
        self.forget()

    def forget(self) -> None:
        """Drop the remembered words."""
        self.index: dict[str, int] = {}
        self.flat, self.bounds = array("i"), array("q", [0])
        for text, i in self.special.items():
            self._keep(_END + text, [i])

    def _keep(self, word: str, ids: list[int]) -> int:
        self.flat.extend(ids)
        self.bounds.append(len(self.flat))
        self.index[word] = at = len(self.index)
        return at

    def _new(self, word: str) -> int:
        spelled = word if word.isascii() else word.encode().decode("latin-1")
        ids = self.ids
        return self._keep(word, [ids[t] for t in self.automaton.path(spelled.translate(self.letters) + _END)])

    def _words(self, text: str) -> list[str]:
        try:
            if not text.isascii():
                text.encode("latin-1")
            return _SPLIT_LATIN.findall(text.lower())
        except UnicodeEncodeError:
            return _SPLIT.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _places(self, text: str) -> Iterator[np.ndarray]:
        """Numbers of the remembered words of a text, part by part."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PART) if len(text) - at > 2 * PART else None
            part, at = (text[at : cut.end()], cut.end()) if cut else (text[at:], len(text))
            pieces = [part]
            if self.special_re and "<" in part:
                pieces, last = [], 0
                for m in self.special_re.finditer(part):
                    pieces += [part[last : m.start()], _END + m[0]]
                    last = m.end()
                pieces.append(part[last:])
            for piece in pieces:
                words = [piece] if piece[:1] == _END and piece[1:] in self.special else self._words(piece)
                get, new = self.index.get, self._new
                yield np.fromiter((i if (i := get(w)) is not None else new(w) for w in words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Token ids of each text; of None, none."""
        places, counts = [], []
        for text in texts:
            found = list(self._places(text)) if text else []
            counts.append(sum(map(len, found)))
            places += found
        words = np.concatenate(places) if places else np.zeros(0, np.int64)
        bounds, flat = np.frombuffer(self.bounds, np.int64), np.frombuffer(self.flat, np.int32)
        if len(self.index) > REMEMBERED:
            self.forget()  # the views keep what they show
        lengths = bounds[words + 1] - bounds[words]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.arange(ends[-1]) + np.repeat(bounds[words] - ends[:-1], lengths)]
        rows = ends[np.concatenate(([0], np.cumsum(counts)))]
        return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The labels of the ids, joined by a space."""
        offsets = ids.offsets.to_numpy()
        flat = ids.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        labels = pa.array(self.labels, pa.string()).take(flat)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), labels), " ")


_loaded: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    """The worker's encoder of a file that ``addFile`` has sent to every executor."""
    if name not in _loaded:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _loaded[name] = Encoder(f.read())
    return _loaded[name]


def _send(spark: SparkSession, tokenizer_file: str) -> str:
    spark.sparkContext.addFile(tokenizer_file)
    return tokenizer_file.rsplit("/", 1)[-1]


def bpe_encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """`docs` with a column `out_col`: array<int> of the token ids of the whole text.

    A null or empty text has no ids. An existing column of that name is replaced; all
    others, repeated rows included, stay as they are. Memory in a task is bounded by a
    batch and by REMEMBERED words; a longer text is encoded in parts."""
    name = _send(docs.sparkSession, tokenizer_file)
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)

    def run(batches):
        encoder = _encoder(name)
        for batch in batches:
            for lo, hi in text_slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, encoder.encode(part.column(at).to_pylist())], [*part.schema.names, out_col])
        encoder.forget()

    return docs.mapInArrow(tidy(run), _with(docs, out_col, T.ArrayType(T.IntegerType())))


def bpe_round_trip(docs: DataFrame, tokenizer_file: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`docs` without `text_col`, with the ids of its texts and the texts that these stand for, as bpe_encode and then bpe_decode give them, in one pass.

    A null or empty text has no ids and an empty decoded text. Columns of the two names are replaced; all others, repeated rows
    included, stay."""
    name = _send(docs.sparkSession, tokenizer_file)
    taken = {ids_col.lower(), out_col.lower()}
    rest = [c for c in docs.columns if c.lower() != text_col.lower() and c.lower() not in taken]
    docs = docs.select(*rest, F.col(text_col).alias(f"{text_col}_"))

    def run(batches):
        encoder = _encoder(name)
        for batch in batches:
            for lo, hi in text_slices(batch.column(len(rest))):
                part = batch.slice(lo, hi - lo)
                ids = encoder.encode(part.column(len(rest)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, encoder.decode(ids).cast(pa.string())], [*rest, ids_col, out_col])
        encoder.forget()

    schema = T.StructType([*docs.schema.fields[:-1], T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(out_col, T.StringType())])
    return docs.mapInArrow(tidy(run), schema)


def bpe_decode(docs: DataFrame, tokenizer_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`docs` with a column `out_col`: the text that the ids of `ids_col` stand for, labels joined by a space.

    Null ids give a null text, an empty list an empty one."""
    name = _send(docs.sparkSession, tokenizer_file)
    docs = docs.drop(out_col)
    at = docs.columns.index(ids_col)

    def run(batches):
        encoder = _encoder(name)
        for batch in batches:
            ends = batch.column(at).offsets.to_numpy()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PART, "right")) - 1)
                part, lo = batch.slice(lo, hi - lo), hi
                ids = part.column(at)
                text = encoder.decode(ids.fill_null(pa.scalar([], ids.type)) if ids.null_count else ids)
                if ids.null_count:
                    text = pc.if_else(pc.is_null(ids), None, text)
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], [*part.schema.names, out_col])

    return docs.mapInArrow(tidy(run), _with(docs, out_col, T.StringType()))


def _with(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField(name, kind)])


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe_round_trip(docs, tokenizer_file)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
