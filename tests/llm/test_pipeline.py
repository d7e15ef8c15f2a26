import random

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_names():
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names}


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("lang = 'en' and length(text) > 1500").first().text
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first().text
    changed = text.split()
    for _ in range(3):
        changed[rnd.randrange(len(changed))] = "zz"
    extra = [(90001, text + " end", "en"), (90002, " ".join(changed) + " end", "en"), (90003, "1234 5678", "en"), (90004, text[:900] + " " + bench, "en"), (90005, " ".join(x + "***" for x in text.split()), "en"), (None, None, None)]
    more = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in extra], docs.schema)
    docs.union(more).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert kept & {90002, 90003, 90004, 90005, None} == set()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in labels if labels[i] == 1]
    assert sum(i in kept for i in good) > 0.7 * len(good)
    assert sum(i in kept for i in labels if labels[i] == 0) <= 2


def test_no_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def odd_stage_docs(spark):
    """Columns that operators add, repeated rows and ids, nulls, blanks, a long text."""
    text = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) > 1500").first().text
    other = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'de' and length(text) > 1500").first().text
    rows = [
        (1, text, "en", "mine", "a"), (1, text, "en", "mine", "b"), (1, other, "de", "mine", "c"), (2, text + " more", "en", "mine", "d"), (3, (other + " ") * 400, "de", "mine", "e"),
        (4, None, None, "mine", "f"), (5, "", "en", "mine", "g"), (6, " \n ", "en", "mine", "h"), (None, text, "en", "mine", "i"), (7, "", None, None, None),
    ]
    names = ["score", "Lang_Pred", "languages", "predicted", "matches", "gone", "N", "ids"]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tag string").select("*", *[F.lit("own").alias(n) for n in names])


def test_stages_keep_the_callers_columns(spark):
    docs = odd_stage_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(r[n] == "own" for r in kept for n in docs.columns[5:]), name
        assert {tuple(r) for r in kept} <= {tuple(r) for r in docs.collect()}, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == [c for c in docs.columns if c not in ("text", "ids")] + ["n_tokens", "ids", "decoded"]
    got = {r.tag: r for r in last.collect()}
    assert len(got) == 10 and (got["f"].n_tokens, got["f"].ids, got["f"].decoded) == (0, [], "") and got["e"].n_tokens > 100_000


def test_near_dedup_of_repeated_ids_and_blanks(spark):
    docs = odd_stage_docs(spark)
    kept = sorted(r.tag or "" for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect())
    # One of the two equal rows of id 1, its other text, not the near copies 2 and 3, all that is blank or has no id.
    assert kept == sorted(["a", "c", "f", "g", "h", "i", ""])
