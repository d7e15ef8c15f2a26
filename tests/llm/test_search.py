import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomlens.llm import decontaminate, license_scan
from fathomlens.llm.decontaminate import EDITS, LEAST, Patterns, benchmark_matches, contaminated, distance, normalise, search
from fathomlens.llm.embedding_dedup import MultiIndex, near_embeddings
from fathomlens.llm.license_scan import CONTAINED, NOT_ALNUM, TEMPLATES, LicenseIndex, scan_licenses, word_hashes
from fathomlens.llm.url_filter import Rule, judge_urls, op8_url_filter


def edits_in(pattern, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def test_banded_alignment_is_exact():
    rnd = random.Random(5)
    for _ in range(400):
        p = bytes(rnd.choice(b"ab c") for _ in range(rnd.randint(1, 20)))
        t = bytes(rnd.choice(b"ab c") for _ in range(rnd.randint(0, 40)))
        if rnd.random() < 0.5:
            t = t[:9] + p[: rnd.randint(1, 20)] + t[9:]
        k = rnd.randint(0, 6)
        assert distance(np.frombuffer(p, np.uint8), np.frombuffer(t, np.uint8), k) == min(edits_in(p, t), k + 1)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_no_match_within_the_budget_is_missed():
    rnd = random.Random(7)
    items = [(i, normalise(prose(rnd, rnd.randint(4, 60)))) for i in range(30)]
    patterns = Patterns.of(items)
    for _ in range(120):
        p = rnd.randrange(len(patterns.texts))
        text = bytearray(patterns.texts[p])
        for _ in range(int(EDITS * len(text))):
            at = rnd.randrange(len(text))
            text[at : at + rnd.randint(0, 1)] = bytes([rnd.choice(b"abcxyz ")]) * rnd.randint(0, 1)
        whole = normalise(prose(rnd, 80)) + b" " + bytes(text) + b" " + normalise(prose(rnd, 20))
        found = {q: e for q, e, _ in search(whole, patterns)}
        assert p in found and found[p] <= edits_in(patterns.texts[p], whole) + 1
        for q, e in found.items():
            assert edits_in(patterns.texts[q], whole) <= e <= patterns.budget[q]


def test_decontamination_rows(spark, odd_docs, no_docs):
    rnd = random.Random(3)
    items = [(1, prose(rnd, 40)), (2, "a word"), (3, None), (None, prose(rnd, 9)), (4, "")]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    copy = items[0][1].upper().replace(" ", ",\n")
    docs = odd_docs.union(spark.createDataFrame([(50, "Intro. " + copy, "en", "x", "y"), (51, prose(rnd, 300), "en", "x", "y"), (50, copy[:-3], "en", "x", "y")], odd_docs.schema))
    got = contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(50, 1, 0)]
    assert [r.doc_id for r in benchmark_matches(docs, bench).where(F.size("matches") > 0).collect()] == [50, 50]
    assert contaminated(no_docs, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert LEAST > len("a word")
    short = spark.createDataFrame([(5, "cat sat on", "z"), (6, "cat sat on a mat", "z")], bench.schema)
    texts = spark.createDataFrame([(1, "The CAT, sat on!"), (2, "a bobcat sat on it"), (3, "cat sat once"), (4, "the cat sat on o mat")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in contaminated(texts, short).collect()} == {(1, 5, 0), (4, 5, 0), (4, 6, 1)}


def test_blocks_of_a_benchmark_give_the_same_rows(spark, odd_docs, monkeypatch):
    rnd = random.Random(12)
    texts = [prose(rnd, 60) for _ in range(9)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(rnd, 50) + " " + t[20:240]) for i, t in enumerate(texts)], "doc_id long, text string")
    once = sorted(map(tuple, contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    assert sorted(map(tuple, contaminated(docs, bench).collect())) == once and {x[0] for x in once} == set(range(9))


def test_phrases_that_many_items_share(monkeypatch):
    rnd = random.Random(11)
    for size in (6, 16, 22):  # below and above what may be left out
        phrase = normalise(prose(rnd, size))
        items = [(i, phrase + b" " + normalise(prose(rnd, 30))) for i in range(24)]
        patterns = Patterns.of(items)
        assert (patterns.left_out > 0).any() and (patterns.left_out < patterns.bound).all()
        text = b" ".join([phrase] * 5 + [items[7][1][: len(phrase) + 90], phrase, items[11][1][40:150], normalise(prose(rnd, 40))])
        found = {p: e for p, e, _ in search(text, patterns)}
        want = {p: e for p, t in enumerate(patterns.texts) if (e := edits_in(t, text)) <= patterns.budget[p]}
        assert found.keys() == want.keys() and all(e >= want[p] for p, e in found.items())
        monkeypatch.setattr(decontaminate, "EXPANDED", 500)  # in halves, and a few patterns at a time
        assert {p: e for p, e, _ in search(text, patterns)}.keys() == want.keys()
        monkeypatch.undo()


def test_license_windows_against_every_window(spark, odd_docs, no_docs, monkeypatch):
    rnd = random.Random(2)
    texts = [prose(rnd, rnd.randint(0, 90)) for _ in range(60)]
    for i in range(0, 60, 2):
        name, notice = TEMPLATES[i // 2 % len(TEMPLATES)]
        words = notice.split()
        if i % 4 == 0:
            words = [w.upper() for w in words]
        texts[i] = " ".join([*texts[i].split()[: rnd.randint(0, 40)], *words, *prose(rnd, rnd.randint(0, 9)).split()])
    index = LicenseIndex.of(TEMPLATES)
    got = {(r, i) for r, i, _, _ in index.search(*word_hashes(pa.array(texts), NOT_ALNUM))}
    want = set()
    for r, text in enumerate(texts):
        words = re.findall("[a-z0-9]+", text.lower())
        for i, (_, notice) in enumerate(TEMPLATES):
            own = re.findall("[a-z0-9]+", notice.lower())
            pairs = set(zip(own, own[1:]))
            if any(len(pairs & set(zip(words[s : s + len(own)], words[s + 1 : s + len(own)]))) >= CONTAINED * len(pairs) for s in range(len(words))):
                want.add((r, i))
    assert want <= got and len(got - want) <= len(got) // 10  # a window is a little wider than a shorter template
    # Long texts in parts give what they give whole.
    joined = [" ".join(texts[:20]), texts[20], " ".join(texts[20:]), ""]
    hashed = word_hashes(pa.array(joined), NOT_ALNUM)
    monkeypatch.setattr(license_scan, "PART", 40)
    assert sorted(index.search_parts(*hashed)) == sorted(index.search(*hashed))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in scan_licenses(docs).collect()} == {(r, TEMPLATES[i][0]) for r, i in got}
    beside = spark.createDataFrame([(1, "nothing here at all"), (2, TEMPLATES[4][1]), (3, "nor here")], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.license, r.word) for r in scan_licenses(beside).collect()] == [(2, "GPL-3.0", 0)]
    assert scan_licenses(odd_docs).count() == 0 and scan_licenses(no_docs).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(i, base[i % 60] + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.4])) for i in range(400)]
    vectors = [(i, [float(x) for x in v]) for i, v in rows]
    vectors += [(900, None), (901, [0.0] * 16), (902, [1.0, None] * 8), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (905, [1.0] * 3), (906, []), (None, vectors[0][1]), (907, vectors[3][1]), (908, vectors[3][1])]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<double>, cell string, links int")
    got = {r.vec_id: r for r in near_embeddings(df).collect()}
    good = [(i, np.array(v)) for i, v in vectors if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.9
    counts = dict(zip([i for i, _ in good], linked.sum(1) - 1))
    found = sum(got[i].n_links for i in counts)
    assert found >= 0.95 * sum(counts.values()) and all(got[i].n_links <= n for i, n in counts.items())
    assert got[908].n_links == got[907].n_links == got[3].n_links and got[908].component_id == got[3].component_id
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    assert got[None].kept and got[None].n_links == 0 and len(got) == len(vectors)
    assert near_embeddings(df.limit(0)).count() == 0


def test_vectors_of_each_size_link_within_it(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.1, 0.0]), (6, [3.0]), (7, [5.0]), (8, [-1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def beside(rng, rows, cosine):
    """Unit vectors at the given cosine from those of `rows`."""
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    other = rng.normal(size=rows.shape)
    other -= (other * rows).sum(1, keepdims=True) * rows
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return cosine[:, None] * rows + np.sqrt(1 - cosine[:, None] ** 2) * other


def embedding_links(spark, rows):
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(rows))), "embedding": pa.array(list(rows))}))
    return {r.vec_id: r for r in near_embeddings(df.repartition(8)).collect()}


def test_rare_embedding_pairs_are_all_found(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(24_000, 64))
    got = embedding_links(spark, np.concatenate((base, beside(rng, base[:60], rng.uniform(0.901, 0.93, 60)))))
    assert [i for i in range(60) if got[i].n_links != 1 or got[24_000 + i].component_id != i] == []
    assert got[0].recall == 1.0 and sum(r.n_links for r in got.values()) == 120


def test_a_dense_group_does_not_hide_the_misses_of_others(spark):
    rng = np.random.default_rng(9)
    dense = np.ones(64) + rng.normal(size=(3000, 64)) * 0.02
    base = rng.normal(size=(9000, 64))
    got = embedding_links(spark, np.concatenate((dense, base, beside(rng, base, rng.uniform(0.901, 0.93, 9000)))))
    found = sum(got[3000 + i].n_links for i in range(9000)) / 9000
    assert found >= 0.98 and abs(found - got[0].recall) < 0.015, (found, got[0].recall)


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 10))
    index = MultiIndex(rows, 7)
    a, b = index.sides(rows)
    sums = (a[:, :, None] + b[:, None, :]).reshape(len(rows), -1)
    for count in (1, 5, 20, 49):
        visits = index.visits(rows, count)
        assert np.allclose(np.take_along_axis(sums, visits, 1), np.sort(sums, 1)[:, :count])
        assert (index.ranks(rows, visits[:, -1]) < count).all()


def test_urls(spark):
    rules = [Rule.of("block", "com/en/"), Rule.of("allow", "example.com/en/7"), Rule.of("block", "net/")]
    urls = ["http://A.Example.COM/en/71?x", "https://example.com/en/8", "x://com/en/", "http://xcom/en/1", None, "no url", "http://q.net", "http://u@h:8/p#://x/y", "://example.com/en/7/"]
    urls += [f"http://spam.shop.org/buy/{i}.html?a" for i in range(30)] + [f"http://fine.org/read/{i}" for i in range(30)]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[1], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, 1) for i in range(9, 24)] + [(i, 0) for i in range(39, 60)], "page_id long, bad int")
    got = {r.page_id: r for r in judge_urls(df, rules, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(9)] == [
        ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("example.com", "/en/8", "com/en/", "block"),
        ("com", "/en/", "com/en/", "block"),
        ("xcom", "/en/1", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("q.net", "", None, "allow"),
        ("u@h:8", "/p", None, "allow"),
        ("example.com", "/en/7/", "example.com/en/7", "allow"),
    ]
    assert {got[i].verdict for i in range(9, 39)} == {"block"} and {got[i].verdict for i in range(39, 69)} == {"allow"}
    assert got[30].template == "/buy/*.html" and judge_urls(df.limit(0), rules).count() == 0
    assert judge_urls(df, rules).count() == len(rows)


def test_url_templates_are_as_long_as_paths(spark):
    urls = [f"http://a.org/x/y/z/{part}/s/t/{i}" for part in ("spam", "docs") for i in range(40)]
    deep = "/".join(["q"] * 700)
    urls += [f"http://b.org/{deep}", "http://b.org/r/q", "http://b.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 80, 2)], "page_id long, bad int")
    got = {r.page_id: r for r in judge_urls(df, [], labels).collect()}
    assert {got[i].verdict for i in range(40)} == {"block"} and {got[i].verdict for i in range(40, 80)} == {"allow"}
    assert got[1].template == "/x/y/z/spam/s/t/*" and got[41].template == "/x/y/z/docs/s/t/*"
    assert [got[i].template for i in (80, 81, 82)] == ["/" + deep, "/r/q", ""]


def test_rare_bad_sections_are_not_lost_among_many(spark):
    name = lambda i: "".join(chr(97 + int(x)) for x in f"{i:03d}")
    urls = [f"http://a.org/{name(i)}/{x}" for i in range(120) for x in range(10)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = {7, 60, 99}
    labels = spark.createDataFrame([(i, int(i // 10 in bad)) for i in range(len(urls)) if i % 10 < 6 and i // 10 != 50], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in judge_urls(df, [], labels).collect()}
    assert {i // 10 for i in got if got[i] == "block"} == bad and sum(v == "block" for v in got.values()) == 30


def test_the_url_query_judges_by_pages_and_pools_small_templates(spark, tmp_path):
    good, bad = "<article><p>" + "some words of a page " * 20 + "</p></article>", "<article>1 2 3 ||</article>"
    rows = [(f"http://fair.org/read/{i}", good) for i in range(30)] + [(f"http://fair.org/junk/{i}", bad) for i in range(30)]
    rows += [(f"http://vile.org/{'abcdefghij'[i // 10]}/x{'abcdefghij'[i % 10]}", bad) for i in range(40)] + [("http://vile.org/new/one", None), ("http://lone.org/a/b/c/d", bad)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in op8_url_filter(spark, str(tmp_path)).collect()}
    assert {got[i].verdict for i in range(30)} == {"allow"} and {got[i].verdict for i in range(30, 60)} == {"block"}
    assert {got[i].verdict for i in range(60, 101)} == {"block"}
    assert got[101].verdict == "allow" and abs(got[101].purity - 0.6) < 1e-9  # one page counts once, however deep
