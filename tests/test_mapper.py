"""Learned mapping, denial spans, search with bounds: each against a plain version."""

import math
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fathomlens.functions import negation
from fathomlens.functions import text as tx
from fathomlens.operators import evaluation, fingerprint, learning, mapper, memory, resemblance
from fathomlens.plans import analyze
from fathomlens.plans.pipeline_queries import knowledge
from fathomlens.sources.sinks import staged


def plain_spans(low):
    """Every cue looks at the rest of the text for itself."""
    out = []
    for cue in negation._CUE.finditer(low):
        start = cue.end()
        stop = negation._END.search(low, start)
        end = stop.start() if stop else len(low)
        if not cue[1] and (joined := negation._AND.search(low, start, end)):
            end = joined.start()
        clause = low[start:end]
        if "," in clause and not negation._LIST.search(clause):
            end = start + clause.index(",")
        words = list(re.finditer(r"\S+", low[start:end]))
        limit = negation.NOUN_REACH if cue[1] else negation.VERB_REACH
        if len(words) > limit:
            end = start + words[limit - 1].end()
        if end > start:
            out.append((start, end))
    return out


def test_denials_are_those_of_the_plain_scan_and_linear():
    rnd = random.Random(2)
    parts = ["no", "not", "nor", "and", "or", ",", ".", "but", "data ", "was not", "without ", "x", " ", "\n", "evidence", "no evidence of", "é", "who", "a-b", "can't", "-"]
    for i in range(3000):
        text = (" " if i % 2 else "").join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert negation.spans(text) == plain_spans(text), text
    began = time.perf_counter()
    assert len(negation.spans("no thing " * 100_000)) == 100_000
    assert len(negation.blanked("no-thing" * 100_000)) == 800_000
    assert time.perf_counter() - began < 30


def test_denied_text_and_tokens_are_blanks(spark):
    text = "Not encrypted on [HOST_REDACTED_2] here. No data, mail or files left the network. Attackers used powershell to act"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    told = mapper.affirmed_sentences(rows, "id", "text").collect()
    assert [(r.doc, r.position, r.sentence) for r in told] == [(1, 2, "Attackers used powershell to act")]
    assert rows.select(negation.affirmed_text(F.col("text")).alias("t")).collect()[1].t is None
    assert negation.blanked("İt was not so. Yes") == "İt was not   . Yes"


EXAMPLES = [
    (1, "T1003.001", "S1", "Dumper", "Dumper dumps credentials from lsass memory"),
    (2, "T1003.001", "S2", "Tool", "The tool dumps lsass memory for credentials"),
    (3, "T1003.002", "S3", "Other", "Other dumps credentials from the sam database"),
    (4, "T1566.001", "G1", "Bear", "Bear sends phishing mail with malicious attachment"),
    (5, "T1566.001", "G2", "Cat", "Cat sends phishing mail with a malicious attachment file"),
    (6, "T1566.002", "G3", "Dog", "Dog sends phishing mail with malicious link"),
    (7, "T1486", "S4", "Lock", "Lock encrypts files and drops a ransom note"),
    (8, "T1486", "S5", "Key", "Key encrypts files on network shares, ransom note"),
]
SCHEMA = "ordinal long, technique string, source string, name string, sentence string"


def grams_of(sentence):
    words = [w for w in (x.rstrip(".-") for x in re.findall(r"[a-z0-9][a-z0-9.-]*", sentence.lower())) if w not in tx.STOP_WORDS and len(w) > 1]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]  # noqa: B905


def unit(sentence, idf):
    counts = defaultdict(int)
    for g in grams_of(sentence):
        counts[g] += 1
    v = {g: (1 + math.log(n)) * idf[g] for g, n in counts.items() if g in idf}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {g: x / norm for g, x in v.items()}


def plain_neighbours(sentences, examples, k):
    masked = [re.sub(re.escape(name), "the actor", s, flags=re.I) if len(name) >= 3 else s for *_, name, s in examples]
    df = defaultdict(int)
    for s in masked:
        for g in set(grams_of(s)):
            df[g] += 1
    idf = {g: math.log((1 + len(masked)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}
    vectors = [unit(s, idf) for s in masked]
    out = {}
    for key, s in sentences:
        q = unit(s, idf)
        sims = sorted(((-round(min(sum(w * v.get(g, 0) for g, w in q.items()), 1), 4), e[0], e[1]) for v, e in zip(vectors, examples, strict=True) if set(v) & set(q)))
        out[key] = [(label, ordinal, -s) for s, ordinal, label in sims[:k]]
    return out


def plain_picks(p, votes, meaning, gate=0.5):
    """One sentence: p {family: p}, votes and meaning {technique: (vote, best, ordinal)}."""
    if meaning and max(b for _, b, _ in meaning.values()) < gate:
        return []
    shares = defaultdict(float)
    for source in (votes, meaning):
        for t, (v, *_) in source.items():
            if t.split(".")[0] in p:
                shares[t.split(".")[0]] += v
    total = sum(shares.values())
    scores = {f: round(0.7 * x + 0.3 * (shares[f] / total if total else 0), 4) for f, x in p.items()}
    out = []
    for f in sorted(scores, key=lambda f: (-scores[f], f))[:2]:
        if scores[f] < 0.2:
            break
        own = defaultdict(float)
        for source in (votes, meaning):
            for t, (v, *_) in source.items():
                if t.split(".")[0] == f:
                    own[t] += v
        t = max(own, key=lambda t: (own[t], t)) if own else f
        out.append((t, scores[f], next((s[t][2] for s in (meaning, votes) if t in s), None)))
    return out


def test_neighbours_votes_and_picks_match_the_plain_version(spark):
    examples = spark.createDataFrame(EXAMPLES, SCHEMA)
    index = mapper.fit(examples, staged)
    sentences = [(1, "They dumped lsass memory and credentials"), (2, "A phishing mail with malicious attachment came"), (3, "The cafeteria is closed on Thursday"), (4, "files encrypted, ransom note; phishing mail"), (5, "credentials from the sam")]
    rows = spark.createDataFrame(sentences, "query long, sentence string")
    near = mapper.neighbours(rows, index, staged, 4)
    got = defaultdict(list)
    for r in near.orderBy("query", F.desc("similarity"), "ordinal").collect():
        got[r.query].append((r.label, r.ordinal, r.similarity))
    want = plain_neighbours(sentences, EXAMPLES, 4)
    assert dict(got) == {k: v for k, v in want.items() if v}
    votes = mapper.votes_of(near)
    ballots = {k: {t: (round(sum(s for x, _, s in v if x == t), 4), max(s for x, _, s in v if x == t), min((-s, o) for x, o, s in v if x == t)[1]) for t in {x for x, *_ in v}} for k, v in want.items()}
    assert {(r.query, r.label): (r.vote, r.best, r.ordinal) for r in votes.collect()} == {(k, t): b for k, v in ballots.items() for t, b in v.items()}
    # the model knows its classes
    p = defaultdict(dict)
    for r in mapper.probabilities(rows, index).collect():
        p[r.query][r.label] = r.p
    assert set(p[1]) == {"T1003", "T1566", "T1486"} and max(p[1], key=p[1].get) == "T1003" and max(p[2], key=p[2].get) == "T1566" and abs(sum(p[3].values()) - 1) < 1e-6
    meaning = {1: {"T1003.002": (3.0, 0.9, 3), "T1486": (1.0, 0.5, 7)}, 2: {"T1566.002": (1.0, 0.4, 6)}, 4: {"T1486": (0.5, 0.6, 8)}}
    by_meaning = spark.createDataFrame([(k, t, *v) for k, m in meaning.items() for t, v in m.items()], "query long, label string, vote double, best double, ordinal long")
    for given, frame in (({}, None), (meaning, by_meaning)):
        found = defaultdict(list)
        for r in mapper.picks(mapper.probabilities(rows, index), votes, frame).orderBy("query", "place").collect():
            found[r.query].append((r.technique, r.score, r.ordinal))
        assert dict(found) == {k: x for k, _ in sentences if (x := plain_picks(p[k], ballots[k], given.get(k, {})))}
    assert {r.technique for r in mapper.agreed(votes).collect()} <= {t for *_, t in []} | {"T1003.001", "T1566.001", "T1486", "T1003.002"}


def test_suggestions_of_reports(spark):
    index = mapper.fit(spark.createDataFrame(EXAMPLES, SCHEMA), staged)
    reports = spark.createDataFrame(
        [(1, "They dumped lsass memory for credentials."), (2, "They did not dump lsass memory for credentials"), (3, None), (4, "A phishing mail with malicious attachment came. It was a quiet day otherwise. Lunch was served at noon."), (5, "")], "doc_id long, text string"
    )
    got = {(r.doc, r.technique): r for r in mapper.suggestions(reports, index, staged).collect()}
    assert (1, "T1003.001") in got and not any(d in (2, 3, 5) for d, _ in got)
    assert got[1, "T1003.001"].evidence.startswith('resembles the example (S') and "lsass" in got[1, "T1003.001"].evidence
    assert all(r.score >= 0.7 for (d, _), r in got.items() if d == 4)
    # composed: what a rule found already gets no second label, but agreement
    facts = spark.createDataFrame([(1, "T1003.001", "phrase", "lsass", 1), (9, "T1566.001", "phrase", "mail", 1)], "doc long, technique string, source string, evidence string, ord long")
    suggested = spark.createDataFrame([(1, "T1003.001", "e", 1), (1, "T1486", "e2", 2), (9, "T1566.002", "e3", 1), (7, "T1005", "e4", 1)], "doc long, technique string, evidence string, place long")
    rows = {(r.doc, r.technique): (r.sources, r.confidence) for r in fingerprint.technique_facts(fingerprint.with_suggestions(facts, suggested)).collect()}
    assert rows == {(1, "T1003.001"): ("example,phrase", 0.8), (1, "T1486"): ("example", 0.6), (9, "T1566.001"): ("phrase", 0.75), (7, "T1005"): ("example", 0.6)}


def test_no_examples_no_suggestions(spark):
    index = mapper.fit(spark.createDataFrame([], SCHEMA), staged)
    assert index.model is None and mapper.suggestions(spark.createDataFrame([(1, "some words that say something")], "doc_id long, text string"), index, staged).count() == 0


def test_analysis_with_a_mapper_and_official_names(spark):
    reports = spark.createDataFrame([(1, "They dumped lsass memory for credentials with Credential Dumping Suite."), (2, "nothing here")], "doc_id long, text string")
    known = knowledge(spark)
    known.examples = mapper.fit(spark.createDataFrame(EXAMPLES, SCHEMA), staged)
    known.official = spark.createDataFrame([(1, "T1900", "Credential Dumping Suite"), (2, "T1901", "malware")], "ordinal int, technique string, name string")
    rows = {r.doc: r.techniques for r in analyze.fingerprints(reports, known).collect()}
    assert "T1003.001" in rows[1] and "T1900" in rows[1] and rows[2] == []


def test_owned_names(spark):
    names = spark.createDataFrame([(1, "T1", "Spearphishing Link"), (2, "T2", "Spearphishing Link"), (3, "T3", "Proxy"), (4, "T4", "credentials"), (5, "T5", "Data Encoding")], "ordinal int, technique string, name string")
    aliases = spark.createDataFrame([(1, "T9", "spearphishing link", 1), (2, "T1", "spearphishing link", 1)], "ordinal int, label string, term string, weight int")
    rows = fingerprint.owned_names(names, aliases).where("source = 'name'").collect()
    assert {(r.label, r.term) for r in rows} == {("T1", "Spearphishing Link"), ("T5", "Data Encoding")}


def test_labels_with_one_ordinal_go_by_name(spark):
    rows = [(1, "b_type", 3, 9), (1, "a_type", 3, 9)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc long, label string, score long, ordinal int").coalesce(1)
        assert fingerprint.classify(df).first().attack_type == "a_type"


def test_confidence_of_sources(spark):
    cases = {("explicit",): 0.95, ("name", "phrase"): 0.85, ("example", "phrase"): 0.8, ("example", "llm"): 0.65, ("llm",): 0.6, ("example", "explicit", "llm"): 0.98, ("other",): 0.55}
    df = spark.createDataFrame([(list(k), v) for k, v in cases.items()], "s array<string>, want double")
    assert all(r.got == r.want for r in df.select("want", fingerprint.confidence(F.col("s"), F.lit(1)).alias("got")).collect())


def test_pruned_postings_give_the_same_and_read_less(spark):
    rnd = random.Random(4)
    words = [f"w{int(rnd.paretovariate(0.6)) % 4000}" for _ in range(6000)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 8, 30])))) for i in range(6000)]
    docs += [(10_000 + i, docs[0][1]) for i in range(300)]  # equal scores, ties by id
    memory_rows = spark.createDataFrame(docs, "doc long, text string")
    asked = spark.createDataFrame([(1, docs[0][1]), (2, "w1 w2 w3"), (3, "w1"), (4, "nothing known"), (5, docs[77][1] + " rare words")], "item long, text string")
    want = memory.top_k(memory.tfidf_scores(asked, memory_rows, "item", "doc"), 10)
    best, read = memory.tfidf_search(asked, memory_rows, "item", "doc", 10, staged)
    rows = lambda df: sorted((r.query, r.place, r.doc, r.score) for r in df.collect())
    assert rows(best) == rows(want)
    counts = {r.query: (r.postings, r["all"]) for r in read.collect()}
    assert all(a <= b for a, b in counts.values()) and sum(a for a, _ in counts.values()) < 0.7 * sum(b for _, b in counts.values())


def test_pivots_give_the_same_and_score_less(spark):
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, [x + rnd.gauss(0, 0.05) for x in rnd.choice(centres)]) for i in range(3000)]
    rows += [(5000 + i, rows[0][1]) for i in range(500)] + [(9000, None), (9001, [0.0] * 8), (9002, [1.0])]
    df = spark.createDataFrame(rows, "doc long, v array<double>")
    asked = df.where("doc % 100 = 0").withColumnRenamed("doc", "query")
    good = df.where("doc < 9000")
    want = memory.top_k(memory.dense_scores(asked.where("query < 9000"), good, 8), 7)
    best, read = memory.dense_top_k(asked, df, 7, 8, staged)
    of = lambda df: sorted((r.query, r.place, r.doc, r.score) for r in df.collect())
    assert of(best) == of(want)
    assert read.agg(F.sum("scored")).first()[0] < 0.5 * read.agg(F.sum("all")).first()[0]
    few = df.where("doc < 3")
    assert of(memory.dense_top_k(few.withColumnRenamed("doc", "query"), few, 7, 8, staged)[0]) == of(memory.top_k(memory.dense_scores(few.withColumnRenamed("doc", "query"), few, 8), 7))


def test_cells_meet_queries_as_products(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], i % 3 or None) for i in range(700)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(300)] + [(9000, [float("nan")] * 4, 1), (9001, [float("inf"), 1.0, 1.0, 1.0], 1), (9002, [0.0] * 4, 1), (9003, None, 1)]
    df = spark.createDataFrame(rows, "doc long, v array<double>, key long")
    asked = df.where("doc % 20 = 0").select(F.col("doc").alias("query"), "v")
    good = memory.dense_scores(asked.where("query < 9000"), df.where("doc < 9000"), 4)
    of = lambda df: sorted((r.query, r.place, r.doc, r.score) for r in df.collect())
    best, read = memory.dense_top_k(asked, df, 6, 4, staged)
    assert of(best) == of(memory.top_k(good, 6)) and all(r.scored <= r["all"] == 1000 for r in read.collect())
    want = learning.strongest(good.join(df.select("doc", "key"), "doc").withColumnRenamed("doc", "ordinal"), ["key"])
    got = memory.dense_strongest(asked, df, 4, block=64)
    assert got.count() <= 4 * -(-1004 // 64) * -(-52 // 64)
    assert {tuple(r) for r in learning.strongest(got.withColumnRenamed("doc", "ordinal"), ["key"]).collect()} == {tuple(r) for r in want.collect()}


def test_held_examples_give_the_same_as_postings(spark, monkeypatch):
    rnd = random.Random(8)
    say = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(rnd.randint(3, 9)))
    examples = spark.createDataFrame([(i, f"T{i % 4}", "s", "", say()) for i in range(90)], "ordinal long, technique string, source string, name string, sentence string")
    told = spark.createDataFrame([(i, say()) for i in range(40)] + [(50, "nothing known here"), (51, None)], "query long, sentence string")
    index = mapper.fit(examples, staged, classify=False)
    rows = lambda: sorted(tuple(r) for r in mapper.neighbours(told, index, staged).collect())
    pruned = memory.pruned_top_k
    calls = []
    monkeypatch.setattr(memory, "pruned_top_k", lambda *a: calls.append(a) or pruned(*a))
    held = rows()
    assert not calls
    monkeypatch.setattr(mapper, "HELD", 10)
    assert rows() == held and len(calls) == 1 and len(held) == 400


def test_votes_of_a_sentence_stay_in_its_row(spark, monkeypatch):
    """Nearest examples, votes and the winner are found where the sentence stands: nothing is shuffled; rows are those of the votes as rows, ties of votes too."""
    rnd = random.Random(2)
    say = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(3, 6)))
    examples = spark.createDataFrame([(i, f"T{i % 5}", "s", "", say()) for i in range(60)], "ordinal long, technique string, source string, name string, sentence string")
    told = spark.createDataFrame([(i, say()) for i in range(60)] + [(90, "nothing known here"), (91, None)], "query long, sentence string")
    index = mapper.fit(examples, staged, classify=False)
    rows = told.select("query", mapper.grams(F.col("sentence")).alias("grams"))
    shown = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    votes = mapper.votes_of(mapper.neighbours(told, index, staged))
    want, won = shown(votes, "query", "label", "vote", "best", "ordinal"), shown(mapper.agreed(votes), "query", "technique", "score", "ordinal")
    for held in (1 << 20, 10):
        monkeypatch.setattr(mapper, "HELD", held)
        near = mapper.with_nearest(rows, index, staged)
        found = mapper.agreed_in_row(near)
        assert shown(near.select("query", F.explode(mapper.ballot("near")).alias("x")).select("query", "x.*"), "query", "label", "vote", "best", "ordinal") == want
        assert shown(found, "query", "technique", "score", "ordinal") == won and won
        assert held == 10 or "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_suggestions_move_only_what_counts(spark):
    """A sentence's probabilities and votes stay in its row, its picks are those of the rows' version, and only suggestions are shuffled, by report."""
    index = mapper.fit(spark.createDataFrame(EXAMPLES, SCHEMA), staged)
    sentences = [(1, "They dumped lsass memory and credentials"), (2, "A phishing mail with malicious attachment came"), (3, "The cafeteria is closed on Thursday"), (4, "files encrypted, ransom note; phishing mail"), (5, "credentials from the sam"), (6, None)]
    told = spark.createDataFrame(sentences, "query long, sentence string")
    shown = lambda df: sorted((r.query, r.technique, r.score, r.ordinal or 0) for r in df.collect())
    want = shown(mapper.picks(mapper.probabilities(told, index), mapper.votes_of(mapper.neighbours(told, index, staged))))
    got = mapper.picked_in_row(mapper.with_nearest(told.select("query", mapper.grams(F.col("sentence")).alias("grams")), index, staged), index)
    assert shown(got) == want and want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    reports = spark.createDataFrame([(1, "They dumped lsass memory for credentials."), (2, None)], "doc_id long, text string")
    written = []
    found = mapper.suggestions(reports, index, lambda df: written.append(df) or staged(df))
    moves = [line.split("hashpartitioning(")[1] for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]
    assert moves and all(m.startswith(("doc#", "technique#", "ordinal#")) for m in moves) and not written


def test_equal_profiles_are_met_once(spark):
    profiles = spark.range(4000).select(F.col("id").alias("profile"), F.explode(F.array(F.lit("T1"), F.lit("T2"), F.concat(F.lit("U"), (F.col("id") % 2).cast("string")))).alias("technique"))
    observed = spark.createDataFrame([(1, "T1"), (1, "T2"), (1, "U1"), (2, "T1"), (2, "X")], "query long, technique string")
    found = resemblance.resemblance(observed, profiles)
    assert [(r.query, r.profile, r.shared, r.place) for r in found.orderBy("place").collect()] == [(1, 1, 3, 1), (1, 3, 3, 2), (1, 5, 3, 3)]
    assert "profiles" in found._jdf.queryExecution().analyzed().toString()


def test_resemblance_by_rarest_pairs(spark):
    rnd = random.Random(6)
    techniques = [f"T{int(rnd.paretovariate(0.7)) % 60}" for _ in range(500)]
    profiles = {(p, rnd.choice(techniques)) for p in range(60) for _ in range(rnd.randint(1, 15))}
    observed = {(q, rnd.choice([*techniques, "X1", "X2"])) for q in range(80) for _ in range(rnd.randint(1, 8))}
    names = sorted({p for p, _ in profiles})
    df = defaultdict(int)
    for _, t in profiles:
        df[t] += 1
    weight = {t: math.log((len(names) + 1) / (n + 1)) + 1 for t, n in df.items()}
    want = set()
    for q in {q for q, _ in observed}:
        own = {t for x, t in observed if x == q}
        whole = sum(weight.get(t, 1.0) for t in own)
        found = []
        for p in names:
            both = own & {t for x, t in profiles if x == p}
            coverage = round(sum(weight[t] for t in both) / whole, 4)
            if len(both) >= 2 and coverage >= 0.30:
                found.append((-coverage, -len(both), p))
        want |= {(q, p, -n, -c, i) for i, (c, n, p) in enumerate(sorted(found)[:3], 1)}
    got = resemblance.resemblance(spark.createDataFrame(sorted(observed), "query long, technique string"), spark.createDataFrame(sorted(profiles), "profile long, technique string"))
    assert {(r.query, r.profile, r.shared, r.coverage, r.place) for r in got.collect()} == want
    with pytest.raises(ValueError):
        resemblance.resemblance(None, None, least_shared=1)


def test_residual_audit_finds_what_shapes_cannot(spark):
    outputs = spark.createDataFrame([(1, "Then layla  alotaibi called [PERSON_REDACTED]."), (2, "Nothing. Laylaalotaibi"), (3, "عميل جديد here, 10-0-0-1"), (4, None)], "doc long, sanitized string")
    values = spark.createDataFrame([("Layla Alotaibi",), ("10.0.0.1",), ("عميل جديد",), ("abc",), ("redacted",), ("...",)], "value string")
    got = {(r.doc, r.value, r.at) for r in evaluation.residual_audit(outputs, values, "doc", "sanitized").collect()}
    assert got == {(1, "Layla Alotaibi", 2), (3, "10.0.0.1", 4), (3, "عميل جديد", 1)}
    assert evaluation.residual_audit(outputs, values.limit(0), "doc", "sanitized").count() == 0


def test_exposures_in_any_schema(spark):
    rows = spark.createDataFrame(
        [(1, "x", [("Acme Bank", {"k": ["a", "of ACME bank."]})], {"acme bank": 5}, 7), (2, None, None, None, None), (3, "acmebank", [(None, None)], {"z": 1}, 10)],
        "id long, a string, b array<struct<c:string,d:map<string,array<string>>>>, m map<string,int>, n int",
    )
    values = spark.createDataFrame([("Acme Bank",), ("10",)], "value string")
    got = {(r.id, r.path, r.value) for r in evaluation.exposures(rows, values, "id").collect()}
    assert got == {(1, "b[].c", "Acme Bank"), (1, "b[].d{value}[]", "Acme Bank"), (1, "m{key}", "Acme Bank"), (3, "n", "10")}


def test_votes_of_equal_labels(spark):
    near = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.5)], "query long, label string, ordinal long, similarity double")
    assert learning.winner(learning.vote(near)).first().label == "b"
