"""Queries that run several operators as one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions
from ..sources.sinks import staged
from . import analyze
from .privacy_queries import docs
from .registry import query, table
from .response_queries import _MATCHES, _ROLL
from .search_queries import _HYBRID, _STRUCT, hybrid_search, vocabulary


def knowledge(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = [(1, "T1001", "released under", 1, 2), (2, "T1002.001", "license", 1, 5), (3, "T1010", "mit license", 1, 7), (4, "T1020", "work", 1, 9), (5, "T1030", "the", 1, 3), (6, "T1040", "of", 1, 11), (7, "T1059.001", "powershell", 1, 3)]
    return analyze.Knowledge(
        vocabulary(spark),
        of(rows, "ordinal int, label string, term string, weight int, rank int"),
        hints=of([("T1059", "ransomware", 3), ("T1001", "release", 2)], "family string, label string, weight int"),
        families=of([(1, "gnu"), (2, "apache")], "ordinal int, term string"),
        decisive=of([(1, "release", "released under the")], "ordinal int, label string, term string"),
        impacts=of([(1, "data_encrypted", "encrypted", 3), (2, "service_outage", "outage", 2), (3, "license_breach", "license", 1)], "ordinal int, label string, term string, weight int"),
        kev=of([("CVE-2024-10003",)], "cve string"),
    )


@query("pln01_fingerprints")
def fingerprints(spark, d):
    """Whole documents as reports; what they say of techniques, CVEs and impacts depends on the document."""
    n = F.col("doc_id")
    told = F.concat(F.lit(" Seen: T1059.00"), (n % 4).cast("string"), F.lit(", CVE-2024-1000"), (n % 10).cast("string"), F.when(n % 5 == 0, "; data was encrypted after an outage. No power cut.").otherwise("; no files encrypted."))
    reports = docs(spark, d).select("doc_id", F.concat(F.coalesce("text", F.lit("")), told).alias("text"))
    rows = analyze.fingerprints(reports, knowledge(spark))
    lists = [F.array_join(c, ",").alias(c) for c in ("techniques", "tactics", "cves", "impacts")]
    return rows.select("doc", "clean", "attack_type", "initial_vector", "severity", *lists, "title", "embedding_text")


_FOUND = f"{_HYBRID}, h AS (SELECT query, doc, score, {_STRUCT} AS structure, recall_place FROM pairs), g AS (SELECT *, round(0.45::DOUBLE * score + 0.55::DOUBLE * structure, 4) AS hybrid FROM h), m AS (SELECT query, doc AS incident_id, hybrid AS similarity, row_number() OVER (PARTITION BY query ORDER BY hybrid DESC, recall_place) AS place FROM g WHERE hybrid >= 0.25 QUALIFY place <= 5)"


@query("pln02_recall_of_actions", f"WITH {_ROLL.replace(_MATCHES, _FOUND)} SELECT query, key, times_used, sources, place, round(score, 2) AS score FROM top")
def recall_of_actions(spark, d):
    """Search, then the ranked actions of what was found, which is written first: it is few rows beside all actions. Scores are rounded as SQL does, times a hundred."""
    found = staged(hybrid_search(spark, d).select("query", F.col("doc").alias("incident_id"), F.col("hybrid").alias("similarity"), "place"))
    return actions.roll_up(found, table(spark, d, "actions")).select("query", "key", "times_used", "sources", "place", (F.round(F.col("score") * 100) / 100).alias("score"))
