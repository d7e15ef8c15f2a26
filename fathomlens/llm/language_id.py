"""Operator 2: languages of a document as a mixture.

Character trigrams of lower-cased words, hashed into BUCKETS, give each word a likelihood under each
learned language. Expectation-maximisation finds the share of each language in a
document's words; the language set is the one with the best likelihood less PENALTY *
(languages - 1) * ln(words), among the best single language and the sets of the
two, three, ... largest shares. The largest share of the chosen set is the prediction. A document is held as its different
words with their numbers, so a long text takes little more than its vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held_out, mix, table, text_slices, tidy

#: Bounds of the sample that the model is fitted on: documents of each language, of all languages, bytes of a document.
TRAIN_DOCS, TRAIN_ALL, TRAIN_BYTES = 1500, 60_000, 1 << 15
BUCKETS = 1 << 17
#: Numbers of languages are broadcast up to so many.
FEW = 50_000
PENALTY, SMOOTH = 3.0, 0.5
#: Expectation-maximisation ends for a document when no share moves by more than STILL, or after ROUNDS.
STILL, ROUNDS = 1e-3, 100
UNKNOWN = "und"
REMEMBERED = 100_000
#: Words of a longer text are taken from parts of about so many characters.
PART = 1 << 19
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s")


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # one row for each bucket, one column for each language


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, in lower case, part by part."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PART) if len(text) - at > 2 * PART else None
        end = gap.end() if gap else len(text)
        yield _WORD.findall(text[at:end].lower())
        at = end


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of the words, each with a space before and after, and where each word's begin."""
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 2)))[:-1]
    keys = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    inside = np.arange(lengths.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths)
    return (mix(keys[inside]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)))[:-1]


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModel:
    """Fit on a sample of the rows with a language, chosen by a hash of the id: about TRAIN_DOCS of each language, less where there are so many that
    these were more than TRAIN_ALL, with texts of at most TRAIN_BYTES.

    Counts are summed in Spark; the driver gets a number for each bucket and language that the sample holds."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sizes.count()
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    if languages <= FEW:  # a row each; texts are never shuffled by language, which a few languages would put into a few tasks
        sizes = F.broadcast(sizes)
    quota = min(float(TRAIN_DOCS), TRAIN_ALL / languages)
    drawn = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 30)) < F.lit(quota) / F.col("n") * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                words = [w for text in own for part in words_of(text) for w in part]
                if words:
                    found, n = np.unique(gram_buckets(words)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n)], ["lang", "bucket", "n"])

    sample = rows.join(sizes, "lang").where(drawn).select("lang", "text")
    found = sample.mapInArrow(tidy(count), "lang string, bucket long, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    order = np.argsort(np.array(names.dictionary.to_pylist(), dtype=object)) if len(names) else np.zeros(0, int)
    counts = np.zeros((BUCKETS, len(names.dictionary)), np.float32)
    counts[found.column("bucket").to_numpy(), order.argsort()[names.indices.to_numpy()]] = found.column("n").to_numpy()
    counts += SMOOTH
    return LanguageModel([names.dictionary[int(i)].as_py() for i in order], np.log(counts / counts.sum(0)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of `values` between neighbouring bounds, none of them equal."""
    return np.add.reduceat(values, bounds[:-1], axis=0)


def _some(bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bounds of these) of the documents at the places `chosen`."""
    sizes = np.diff(bounds)[chosen]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return np.arange(ends[-1]) + np.repeat(bounds[:-1][chosen] - ends[:-1], sizes), ends


def _mixture(like: np.ndarray, times: np.ndarray, bounds: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log likelihood) of each document, with shares only where `allowed`.

    like: a row for each different word, with a maximum of 1; times: how often it is there; bounds: of each document's rows."""
    shares = allowed / allowed.sum(1, keepdims=True)
    going, part, n, ends = np.arange(len(shares)), like, times, bounds
    for _ in range(ROUNDS):
        sizes = np.diff(ends)
        held = part * np.repeat(shares[going], sizes, axis=0)
        held *= (n / (held.sum(1) + 1e-300))[:, None]
        new = _sums(held, ends) / _sums(n, ends)[:, None]
        moved = np.abs(new - shares[going]).max(1) > STILL
        shares[going] = new
        if not moved.any():
            break
        if moved.sum() < 0.7 * len(moved):
            rows, ends = _some(ends, np.flatnonzero(moved))
            going, part, n = going[moved], part[rows], n[rows]
    held = (like * np.repeat(shares, np.diff(bounds), axis=0)).sum(1)
    return shares, _sums(times * np.log(held + 1e-300), bounds)


def mixtures(logs: np.ndarray, times: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Chosen shares of each document. logs: a row for each different word; times: its number; bounds: of each document's words, at least one each."""
    like = np.exp(logs - logs.max(1, keepdims=True))
    count = logs.shape[1]
    alone = _sums(times[:, None] * np.log(like + 1e-300), bounds)
    best = alone.max(1)
    chosen = (np.arange(count) == alone.argmax(1)[:, None]).astype(float)
    cost = PENALTY * np.log(_sums(times, bounds) + 1.0)
    shares, full = _mixture(like, times, bounds, np.ones_like(chosen))
    order = np.argsort(-shares, 1, kind="stable").argsort(1)
    for size in range(2, count + 1):
        # No smaller set is likelier than the full one: where that can't pay for another language, none is tried.
        mixed = np.flatnonzero(full - cost * (size - 1) > best)
        if not len(mixed):
            break
        rows, ends = _some(bounds, mixed)
        found, gain = _mixture(like[rows], times[rows], ends, (order[mixed] < size).astype(float))
        gain -= cost[mixed] * (size - 1)
        better = gain > best[mixed]
        best[mixed[better]] = gain[better]
        chosen[mixed[better]] = found[better]
    return chosen


class _Predictor:
    def __init__(self, model: LanguageModel):
        self.model, self.index, self.rows = model, {}, np.zeros((1 << 12, len(model.languages)), np.float32)

    def _learn(self, words: list[str]) -> None:
        buckets, starts = gram_buckets(words)
        found = np.add.reduceat(self.model.logs[buckets], starts, axis=0)
        first = len(self.index)
        while first + len(words) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[first : first + len(words)] = found
        self.index.update(zip(words, range(first, first + len(words)), strict=True))

    def _places(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.index))
        if new:
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        shares = np.zeros((len(texts), len(self.model.languages)))
        if self.model.languages:
            if len(self.index) > REMEMBERED:
                self.index, self.rows = {}, self.rows[: 1 << 12]
            keys, span = [], 1 << 40
            for n, text in enumerate(texts):
                own = [self._places(words) for words in words_of(text)] if text else []
                if sum(map(len, own)):
                    keys.append(np.concatenate(own) + n * span)
            if keys:
                kinds, times = np.unique(np.concatenate(keys), return_counts=True)
                doc = kinds // span
                starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                shares[doc[starts]] = mixtures(self.rows[kinds % span].astype(float), times.astype(float), np.append(starts, len(doc)))
        top = shares.argmax(1) if shares.shape[1] else np.zeros(len(texts), np.int64)
        score = shares.max(1, initial=0)
        return [self.model.languages[i] if s > 0 else UNKNOWN for i, s in zip(top, score, strict=True)], score, shares


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (the largest share, 0 to 1) and languages (map of the chosen set's shares).

    A null text, or one without a letter, is `und` with score 0 and an empty map; so is any text if
    nothing was learned. Ties go to the first language by name. Columns of these names are replaced,
    all others and repeated rows stay. Texts are taken whole; a task holds a slice of a batch."""
    docs = docs.drop("lang_pred", "score", "languages")
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language of the sample

    def run(batches):
        predictor = _Predictor(sent.value)
        names = sent.value.languages
        for batch in batches:
            for lo, hi in text_slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                best, score, shares = predictor(part.column(at).to_pylist())
                maps = pa.array([[(n, float(x)) for n, x in zip(names, row, strict=True) if x > 0] for row in shares], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best), pa.array(score), maps], [*part.schema.names, "lang_pred", "score", "languages"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))]
    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *added]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))
