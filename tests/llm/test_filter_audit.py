import itertools
import re

from fathomlens.llm import shared
from fathomlens.llm.filter_audit import filter_interactions

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    """Every order applied to every document, one after another."""
    rows = []
    for r in docs:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == text for o in docs),
        }
        marks = [x for x in labels if x.doc_id == r.doc_id and r.doc_id is not None]
        rows.append((r.lang or "", {k for k, v in fails.items() if v}, any(x.quality == 1 for x in marks), any(x.toxic == 1 for x in marks)))
    out = set()
    for part in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == part]
        removed_in, steps = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                left = [x for x in left if f not in x[1]]
                removed_in[f] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        out |= {(*s[:-1], removed_in[s[-1]]) for s in steps}
    return out


def found(docs, labels):
    out = filter_interactions(docs, labels)
    assert out.columns == COLUMNS
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    more = spark.createDataFrame(
        [
            (20, "a b c", "en", "x", "y"),
            (21, "a b c", "de", "x", "y"),
            (21, "a b c", "de", "x", "z"),  # a row that repeats
            (21, "other text of the same id #", "de", "x", "z"),
            (19, " ".join(f"w{i}" for i in range(150)), "fr", "x", "y"),  # fails nothing
            (22, " ".join(f"w{i}" for i in range(150)), "fr", "x", "y"),  # a copy only
            (22, " ".join(f"w{i}" for i in range(150)), "fr", "x", "y"),
            (23, "UPPER " * 120, "fr", "x", "y"),
            (24, "a $ b", "", "x", "y"),
            (None, "a b c", "fr", "x", "y"),
        ],
        odd_docs.schema,
    )
    docs = odd_docs.union(more)
    labels = spark.createDataFrame([(21, 1, 0), (21, 0, 1), (22, 1, None), (6, 0, 1), (99, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    want = plain(docs.collect(), labels.collect())
    assert found(docs, labels) == want and len(want) == 600 * 4
    monkeypatch.setattr(shared, "HOT", 4)  # the copies' hash is a frequent key now
    assert found(docs, labels) == want
    clash = docs.withColumnRenamed("score", "h").withColumnRenamed("n_tokens", "bits").withColumn("deal", docs.lang)
    assert found(clash, labels) == want
    assert found(no_docs, labels) == set()
    assert found(docs, labels.limit(0)) == {(*x[:7], 0, 0, x[9]) for x in want}


def test_many_copies_are_dealt_out(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text", "'en' as lang").repartition(4)
    hashes = docs.selectExpr("doc_id", "xxhash64(text) as h")
    keys = hashes.groupBy("h").count()
    left, right = shared.dealt(hashes, keys, "h", "count", hashes.doc_id)
    joined = left.join(right, ["h", "deal"])
    assert joined.count() == 3000
    assert joined.groupBy("h", "deal").count().agg({"count": "max"}).first()[0] < 20
    got = {r.filter_order: r for r in filter_interactions(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("step = 1").collect()}
    assert got["EABCD"].removed == 999 and got["EABCD"].kept == 2001 and got["ABCDE"].removed == 3000
