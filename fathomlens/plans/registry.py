"""Queries by name, with the SQL that must give the same rows, and the stand-ins for incident tables.

The driver's tables hold no incidents. Orders stand in for incidents, line items for their actions and technique
facts; the expressions below are read by Spark and by the SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_INCIDENTS = (
    "orders",
    [
        "o_orderkey AS incident_id",
        "o_orderdate AS created_at",
        "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS occurred_at",
        "CASE o_orderkey % 5 WHEN 0 THEN 'internal' WHEN 1 THEN 'public' WHEN 2 THEN 'synthetic' WHEN 3 THEN 'shared' END AS provenance",
        "CASE o_custkey % 6 WHEN 0 THEN 'ransomware' WHEN 1 THEN 'phishing' WHEN 2 THEN 'data_breach' WHEN 3 THEN 'supply-chain' WHEN 4 THEN 'ddos' END AS attack_type",
        "CASE o_orderkey % 4 WHEN 0 THEN 'phishing' WHEN 1 THEN 'exposed_service' WHEN 2 THEN 'stolen_credentials' ELSE 'unknown' END AS initial_vector",
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'odd' END AS severity",
        "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 13 END AS redactions",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 7 END AS contributor_ref",
        "CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat('incident of type ', CAST(o_custkey % 6 AS VARCHAR(9))) END AS embedding_text",
    ],
)
_ACTIONS = (
    "lineitem",
    [
        "l_orderkey AS incident_id",
        "CAST(l_linenumber AS BIGINT) AS position",
        "CASE WHEN l_linenumber % 3 = 0 THEN concat('  Action ', CAST(l_partkey % 40 AS VARCHAR(9))) ELSE concat('action ', CAST(l_partkey % 40 AS VARCHAR(9))) END AS action",
        "CASE l_suppkey % 6 WHEN 0 THEN 'detect' WHEN 1 THEN 'contain' WHEN 2 THEN 'eradicate' WHEN 3 THEN 'recover' WHEN 4 THEN 'harden' ELSE 'other' END AS category",
        "CASE WHEN l_partkey % 40 > 3 AND l_suppkey % 5 <> 0 THEN l_discount * 10 END AS effectiveness",
    ],
)
_FACTS = (
    "lineitem",
    [
        "l_orderkey AS incident_id",
        "CAST(l_linenumber AS BIGINT) AS ord",
        "CASE WHEN l_linenumber % 2 = 0 THEN concat('T', CAST(1000 + l_partkey % 60 AS VARCHAR(9))) ELSE concat('T', CAST(1000 + l_partkey % 60 AS VARCHAR(9)), '.00', CAST(l_suppkey % 3 + 1 AS VARCHAR(9))) END AS technique",
        "l_partkey % 14 AS rank",
    ],
)
STAND_INS = {"incidents": _INCIDENTS, "actions": _ACTIONS, "facts": _FACTS}
CTES = ", ".join(f"{name} AS (SELECT {', '.join(columns)} FROM {source})" for name, (source, columns) in STAND_INS.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table, or one of the stand-ins."""
    if name in STAND_INS:
        source, columns = STAND_INS[name]
        return table(spark, sf_dir, source).selectExpr(*columns)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, ctes: bool = True):
    """Register a query; `sql` may use the stand-ins, which are put before it (a leading WITH is merged)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            text = sql.strip()
            used = ctes and any(n in text for n in STAND_INS)
            if used:
                text = f"WITH {CTES}, {text[5:]}" if text.startswith("WITH ") else f"WITH {CTES} {text}"
            SQL[name] = text
        return f

    return add
