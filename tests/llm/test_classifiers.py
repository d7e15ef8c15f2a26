import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlens.llm import language_id, quality
from fathomlens.llm.shared import held_out

SOUNDS = {"en": ["the", "ing", "tion", "er", "an", "wh"], "fr": ["eau", "que", "é", "oi", "ment", "è"], "de": ["sch", "ung", "ü", "ver", "ei", "ß"]}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        lang = rnd.choice(list(SOUNDS))
        good = rnd.random() < 0.7
        text = prose(rnd, lang, rnd.randint(3, 80))
        if not good:
            text = rnd.choice([text.upper() + "!!", " ".join(w + "***" for w in text.split()), " ".join([text.split()[0]] * 30)])
        rows.append((i, text, lang, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").cache()


def test_language_on_held_out_rows(spark, corpus):
    good = corpus.where("quality = 1")
    model = language_id.fit(good.where(~held_out(F.col("doc_id"))))
    assert model.languages == sorted(SOUNDS)
    found = language_id.predict_languages(good, model).where(held_out(F.col("doc_id"))).collect()
    assert len(found) > 30 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(abs(sum(r.languages.values()) - 1) < 1e-6 for r in found)


def test_mixture_of_two_languages(spark, corpus):
    model = language_id.fit(corpus.where("quality = 1"))
    rnd = random.Random(9)
    texts = [(1, prose(rnd, "en", 120) + " " + prose(rnd, "fr", 60)), (2, prose(rnd, "de", 150))]
    got = {r.doc_id: r for r in language_id.predict_languages(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert set(got[1].languages) == {"en", "fr"} and abs(got[1].languages["en"] - 2 / 3) < 0.08 and got[1].lang_pred == "en"
    assert got[2].languages == {"de": 1.0}


def test_em_reaches_the_maximum():
    rng = np.random.default_rng(3)
    logs = np.log(rng.uniform(0.01, 1, (50, 2)))
    shares, like = language_id._mixture(np.exp(logs - logs.max(1, keepdims=True)), np.ones(50), np.array([0, 50]), np.ones((1, 2)))
    grid = [np.log(np.exp(logs) @ [a, 1 - a]).sum() for a in np.linspace(0, 1, 1001)]
    assert max(grid) - np.log(np.exp(logs) @ shares[0]).sum() < 0.05


def test_chosen_sets_against_brute_force():
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(40):
        logs = np.log(rng.dirichlet([0.3] * 4, rng.integers(3, 60)) + 1e-6)
        for word in range(len(logs)):  # words of the first languages of the text
            own = rng.integers(0, rng.integers(1, 4))
            logs[word, own] += rng.uniform(0, 4)
        texts.append((logs, rng.integers(1, 4, len(logs))))
    bounds = np.concatenate(([0], np.cumsum([len(x) for x, _ in texts])))
    got = language_id.mixtures(np.concatenate([x for x, _ in texts]), np.concatenate([t for _, t in texts]).astype(float), bounds)
    sizes = []
    for (logs, times), shares in zip(texts, got):
        like = np.exp(logs - logs.max(1, keepdims=True))
        cost = language_id.PENALTY * np.log(times.sum() + 1)
        value, full = {}, None
        for subset in range(15, 0, -1):
            allowed = np.array([subset >> i & 1 for i in range(4)], float)
            part = allowed / allowed.sum()
            for _ in range(400):
                held = like * part
                part = (held / held.sum(1, keepdims=True) * times[:, None]).sum(0) / times.sum()
            full = part if full is None else full
            value[subset] = (times * np.log((like * part).sum(1))).sum() - cost * (allowed.sum() - 1)
        mine = sum(1 << i for i in range(4) if shares[i] > 0)
        largest = np.argsort(-full)
        tried = [1 << i for i in range(4)] + [sum(1 << int(i) for i in largest[:n]) for n in (2, 3, 4)]
        assert mine in tried and value[mine] > max(value[x] for x in tried) - 0.1
        sizes.append(bin(mine).count("1"))
    assert {1, 2} <= set(sizes)


def test_long_and_repeated_words_count_as_if_written_out(corpus):
    model = language_id.fit(corpus)
    rnd = random.Random(2)
    text = prose(rnd, "en", 300) + " " + prose(rnd, "fr", 200)
    whole = language_id._Predictor(model)([text])
    language_id.PART, before = 200, language_id.PART
    assert np.allclose(language_id._Predictor(model)([text])[2], whole[2])
    language_id.PART = before
    assert np.allclose(language_id._Predictor(model)([text + " " + text])[2], whole[2], atol=0.01)


def test_odd_rows(spark, odd_docs, no_docs, corpus):
    for docs in (odd_docs, no_docs):
        for model in (language_id.fit(corpus), language_id.fit(no_docs)):
            rows = language_id.predict_languages(docs, model).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
            assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not any(c.isalpha() for c in r.text or ""))
        for model in (quality.fit(corpus, corpus), quality.fit(no_docs, corpus)):
            rows = quality.score_quality(docs, model).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
            assert len({r.score for r in rows if not (r.text or "").split()}) <= 1


def test_quality_on_held_out_rows(corpus):
    labels = corpus.where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = quality.fit(corpus, labels)
    rows = quality.score_quality(corpus, model).where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_folded_scores_are_the_model(corpus):
    model = quality.fit(corpus, corpus)
    for r in quality.score_quality(corpus, model).limit(20).collect():
        words = r.text.split()
        buckets, starts = quality.features(words)
        parts = np.split(buckets, starts[1:])
        mean = (sum(model.vectors[p].mean(0) for p in parts) + quality.repeats(words) * model.vectors[-1]) / len(words)
        odds = mean @ model.layer + model.bias
        assert abs(r.score - 1 / (1 + np.exp(odds[0] - odds[1]))) < 1e-4
