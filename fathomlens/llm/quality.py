"""Operator 1: document quality by supervised subword embeddings.

A word is the mean of hashed vectors of itself and of its character n-grams; where it repeats
the word before it, the vector of such word pairs is added. A document is the
mean of its words, and a softmax layer over that mean gives the quality. All
vectors and the layer are trained together by numpy stochastic gradient descent. As
averages and layer are linear, a trained model scores a word by one number, which
workers remember, so scoring costs one look-up a word."""

from __future__ import annotations

import itertools
import operator
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held_out, mix, table, text_slices, tidy

#: Bounds of the sample that the model is fitted on.
TRAIN_DOCS, TRAIN_BYTES = 3000, 1 << 14
BUCKETS, DIM, NGRAMS = 1 << 17, 8, (1, 2, 3)
STEPS, EPOCHS, RATE = 24_000, 40, 0.3  # as many epochs as make STEPS steps, EPOCHS at most
ACCEPT = 0.7
REMEMBERED = 150_000


@dataclass
class QualityModel:
    vectors: np.ndarray  # (BUCKETS + 1) x DIM
    layer: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def weights(self) -> tuple[np.ndarray, float]:
        """Log odds of quality 1: of each bucket (the last is that of repeated words), and of a text without words."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of the words, and where each word's begin: its whole and its n-grams, with word borders."""
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate(([0], np.cumsum(lengths)))
    word_of = np.repeat(np.arange(len(words)), lengths)
    place = (np.arange(len(codes)) - starts[word_of]).astype(np.uint64)
    whole = np.add.reduceat(mix(codes * np.uint64(0x9E3779B97F4A7C15) + place), starts[:-1])
    parts, owners = [mix(whole)], [np.arange(len(words))]
    for n in NGRAMS:
        key = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i]
        ok = (word_of[: len(key)] == word_of[n - 1 :]) & (codes[: len(key)] != 32 if n == 1 else True)
        parts.append(mix(key[ok] + np.uint64(n << 56)))
        owners.append(word_of[: len(key)][ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(parts)[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(words)))


def repeats(words: list[str]) -> int:
    """Words that equal the one before."""
    return sum(map(operator.eq, words, itertools.islice(words, 1, None)))


def train(texts: list[str], labels: list[int], seed: int = 1) -> QualityModel:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for text in texts:
        words = text.split()
        if words:
            buckets, starts = features(words)
            size = np.diff(np.append(starts, len(buckets)))
            ids, at = np.unique(buckets, return_inverse=True)
            weight = np.bincount(at, 1 / np.repeat(size, size) / len(words))
            rows.append((np.append(ids, BUCKETS).astype(np.int32), np.append(weight, repeats(words) / len(words)).astype(np.float32)))
        else:
            rows.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
    epochs = min(EPOCHS, -(-STEPS // max(1, len(rows))))
    steps = epochs * len(rows)
    for step, i in enumerate(i for _ in range(epochs) for i in rng.permutation(len(rows))):
        ids, weight = rows[i]
        own = vectors[ids]
        mean = weight @ own
        odds = mean @ layer + bias
        error = np.exp(odds - odds.max())
        error /= error.sum()
        error[labels[i]] -= 1
        rate = np.float32(RATE * (1 - step / steps))
        back = layer @ error
        layer -= rate * np.outer(mean, error)
        bias -= rate * error
        # A mean spreads its gradient thinly over many words, so vectors take a larger step.
        vectors[ids] = own - (rate * 50) * np.outer(weight, back).astype(np.float32)
    return QualityModel(vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    """Fit on at most TRAIN_DOCS labelled documents, chosen by a hash of the id, of at most TRAIN_BYTES each.

    `labels` has a row (id, 0 or 1) for some documents; null labels are ignored, an id with several has their
    rounded mean. Training runs in one task, which the bounds limit to TRAIN_DOCS * TRAIN_BYTES bytes. None
    if nothing is labelled."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(label_col)).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64(F.lit(1), "id")).limit(TRAIN_DOCS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    sample = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # TRAIN_DOCS rows of two numbers; of a repeated id, the least text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*frames, pd.DataFrame({"id": [], "label": [], "text": []})]).sort_values("id")
        if len(rows):
            yield pd.DataFrame({"model": [pickle.dumps(train(rows.text.tolist(), rows.label.astype(int).tolist()))]})

    found = sample.select("id", "label", "text").repartition(1).mapInPandas(tidy(run), "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def score_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """`docs` with score (0 to 1, higher: quality 1 likelier) and predicted (1 if score >= ACCEPT).

    A null or empty text gets the score of the model's bias, any text 0.5 if there was nothing to learn. Columns
    of these names are replaced, all others and repeated rows stay. Texts are scored whole."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model.weights() if model else (np.zeros(BUCKETS + 1), 0.0))

    def run(batches):
        weights, bias = sent.value
        known: dict[str, float] = {}
        for batch in batches:
            for lo, hi in text_slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                odds = np.full(part.num_rows, bias)
                rows = [t.split() if t else [] for t in part.column(at).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list(dict.fromkeys(w for words in rows for w in words if w not in known))
                if new:
                    buckets, starts = features(new)
                    means = np.add.reduceat(weights[buckets], starts) / np.diff(np.append(starts, len(buckets)))
                    known.update(zip(new, means.tolist(), strict=True))
                for i, words in enumerate(rows):
                    if words:
                        odds[i] += (sum(map(known.__getitem__, words)) + repeats(words) * weights[BUCKETS]) / len(words)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], [*part.schema.names, "score"])

    scored = docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score_quality(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
