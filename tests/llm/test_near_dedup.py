import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from fathomlens.llm.near_dedup import band_rows, estimate, near_duplicates, op4_minhash_near_dedup, signature
from fathomlens.llm.shared import components, mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(docs, k, percent):
    sets = {i: shingle_set(t, k) for i, t in docs}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in roots(sets, links).items()}


def corpus(n=160, seed=2):
    """Texts with exact copies, chains of ever more edited copies, borderline pairs and a shared passage."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    texts = []
    while len(texts) < n:
        own = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 8, 30, 120]))]
        if rnd.random() < 0.3:
            own += passage
        for _ in range(rnd.choice([1, 1, 2, 6])):
            texts.append(" ".join(own))
            if rnd.random() < 0.2:
                texts.append(" ".join(own).upper())
            own = list(own)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, k, percent).collect()}
        assert got == brute(docs, k, percent)


def test_query(spark, tmp_path):
    docs = corpus(60, seed=4)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = op4_minhash_near_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[7].component_id == 6 and not by[7].kept and by[6].kept
    assert [by[i].n_shingles for i in (2, 3, 4, 8)] == [0, 0, 0, 1]
    assert all(by[i].component_id == i for i in (1, 2, 3, 4, 5, 8, 9, 10))
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_duplicates(no_docs).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.85, 0.95):
        errors = []
        for size in (50, 400, 3000):
            common = int(size * 2 * share / (1 + share))
            pool = mix(rng.integers(0, 2**62, 2 * size - common).astype(np.uint64))
            a, b = np.unique(pool[:size]), np.unique(pool[size - common :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            ones = np.bitwise_count((signature(a, 8)[1] ^ signature(b, 8)[1]).view(np.uint64)).sum()
            errors.append(abs(float(estimate(ones)) - true))
        assert max(errors) < 0.1
    assert band_rows(0.85) == 8 and band_rows(0.8) == 6


def test_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randint(2000, 2200), rnd.randint(2000, 2200)) for _ in range(150)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == roots({x for link in real for x in link}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
