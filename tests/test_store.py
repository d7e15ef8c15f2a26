"""Versions appear whole or not at all, and the memory stays what a rebuild would make it."""

import pytest
from pyspark.sql import functions as F

from fathomlens.operators import memory
from fathomlens.sources import corpora, store
from fathomlens.sources.sinks import staged

INCIDENTS, ACTIONS = "incident_id long, embedding_text string, title string", "incident_id long, action string"


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "store"))


def some(spark, ids):
    texts = ["mail with attachment opened", "files encrypted by ransomware", "mail server exposed", "stolen password used on mail"]
    return spark.createDataFrame([(i, texts[i % 4] + f" case {i % 3}", "t") for i in ids], INCIDENTS), spark.createDataFrame([(i, "reset") for i in ids], ACTIONS)


def found(kept, spark):
    asked = spark.createDataFrame([(1, "mail attachment"), (2, "ransomware case 1")], "q long, text string")
    return sorted((r.query, r.place, r.doc, r.score) for r in kept.search(asked, "q", "text", 5, staged).collect())


def rebuilt(kept, spark):
    asked = spark.createDataFrame([(1, "mail attachment"), (2, "ransomware case 1")], "q long, text string")
    rows = kept.table("incidents").select("incident_id", F.col("embedding_text").alias("text")).where("coalesce(text, '') <> ''")
    return sorted((r.query, r.place, r.doc, r.score) for r in memory.top_k(memory.tfidf_scores(asked, rows, "q", "incident_id"), 5).collect())


def test_add_and_delete_keep_the_scores_of_a_rebuild(spark, kept):
    assert kept.manifest() == (0, [], [], 0) and kept.table("incidents") is None and found(kept, spark) == [] and kept.delete(some(spark, [1])[0]) == 0
    assert kept.add(*some(spark, range(8))) == 1
    before = found(kept, spark)
    assert before == rebuilt(kept, spark) and before
    incidents, actions = some(spark, range(8, 14))
    assert kept.add(incidents.union(spark.createDataFrame([(99, None, "t")], INCIDENTS)), actions) == 2
    assert found(kept, spark) == rebuilt(kept, spark) != before
    assert kept.delete(spark.createDataFrame([(i,) for i in [*range(8, 14), 99, 1000]], "incident_id long")) == 3
    assert found(kept, spark) == before == rebuilt(kept, spark)
    assert kept.table("actions").count() == 8 and kept.manifest()[3] == 8
    assert kept.table("incidents", version=2).count() == 15  # older versions stay readable
    assert kept.add(*some(spark, [8])) == 4  # an id may come back
    assert kept.table("incidents").where("incident_id = 8").count() == 1 and found(kept, spark) == rebuilt(kept, spark)


def test_a_failed_write_leaves_the_version_before_it(spark, kept):
    kept.add(*some(spark, range(4)))
    before = found(kept, spark)
    incidents, _ = some(spark, [7])
    broken = incidents.select("incident_id", F.raise_error(F.lit("no disk")).cast("string").alias("action"))
    with pytest.raises(Exception, match="no disk"):
        kept.add(incidents, broken)
    assert kept.manifest()[0] == 1 and found(kept, spark) == before and kept.table("incidents").count() == 4
    for bad in (some(spark, [3]), some(spark, [8, 8]), (spark.createDataFrame([(None, "x", "t")], INCIDENTS), some(spark, [])[1]), (some(spark, [9])[0], some(spark, [10])[1])):
        with pytest.raises(ValueError):
            kept.add(*bad)
    assert kept.manifest()[0] == 1 and kept.table("actions").count() == 4


def test_ids_are_not_broadcast(spark, kept, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    plans = []
    joined = DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda *a, **k: plans.append(joined(*a, **k)) or plans[-1])
    kept.add(*some(spark, range(9)))
    kept.delete(spark.createDataFrame([(3,)], "incident_id long"))
    kept.add(*some(spark, [20]))
    assert len(plans) >= 6 and not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]


REFS = "array<struct<source_name:string,external_id:string>>"


def test_bundles_resolve_typed_edges(spark):
    ref = lambda code: [("x", "no"), (corpora.SOURCE, code)]
    schema = f"type string, id string, name string, description string, revoked boolean, x_mitre_deprecated boolean, external_references {REFS}, relationship_type string, source_ref string, target_ref string, aliases array<string>"
    node = lambda kind, i, name, code, text="d", revoked=None, old=None: (kind, i, name, text, revoked, old, ref(code), None, None, None, ["z"])
    edge = lambda kind, a, b, text=None, revoked=None: ("relationship", f"{a}{b}", None, text, revoked, None, None, kind, a, b, None)
    rows = [
        node("attack-pattern", "t1", "One", "T1"), node("attack-pattern", "t2", "Two", "T2", old=True), node("attack-pattern", "t3", "Three", "T3"),
        node("course-of-action", "m1", "M", "M1", " " + "x" * 601), node("course-of-action", "m2", "Old", "T1"),
        node("intrusion-set", "g1", "G", "G1", "a" * 399 + "  bc"), node("intrusion-set", "g2", "Idle", "G2"), node("intrusion-set", "g3", "Gone", "G3", revoked=True),
        node("malware", "s1", "S", "S1"), node("campaign", "c1", "C", "C1"),
        edge("mitigates", "m1", "t1"), edge("mitigates", "m1", "t2"), edge("mitigates", "m2", "t3"),
        edge("uses", "g1", "t3", "[G](https://x.org) has used <code>cmd</code> to run(Citation: y)"), edge("uses", "g1", "t1", "too short"), edge("uses", "g1", "t2", "a b c d e"), edge("uses", "g2", "t1", "a b c d", True), edge("uses", "g3", "t1", "a b c d"),
        edge("uses", "s1", "t1", "S can use one thing"), edge("attributed-to", "c1", "g1"), edge("attributed-to", "c1", "g3"),
    ]
    objects = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in corpora.mitigations(objects).collect()] == [("M1", "M", "x" * 600 + "...", ["T1"])]
    assert [tuple(r) for r in corpora.groups(objects).collect()] == [("G1", "G", ["z"], "a" * 399 + "...", ["T1", "T3"])]
    assert [(r.code, r.kind, r.techniques) for r in corpora.software(objects).collect()] == [("S1", "malware", ["T1"])]
    assert [(r.code, r.attributed_to, r.attributed_to_name, r.techniques) for r in corpora.campaigns(objects).collect()] == [("C1", "G3", "Gone", [])]
    assert [tuple(r) for r in corpora.bundle_examples(objects).orderBy("ordinal").collect()] == [(1, "T1", "S1", "S", "S can use one thing"), (2, "T3", "G1", "G", "G has used cmd to run")]
    assert {(r.control, r.technique) for r in corpora.controls_of(objects.drop("x_mitre_deprecated", "aliases")).collect()} == {("M1", "T1"), ("M1", "T2")}
    assert corpora.groups(objects.limit(0)).count() == 0
