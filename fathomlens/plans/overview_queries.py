"""Overview, catalogue and table-maintenance queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog, overview
from ..operators.overview import PHASES, SEVERITIES
from ..sources import corpora, store
from ..sources.sinks import shared_folder
from .privacy_queries import _sql_tokens
from .registry import query, table

_ORDER = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEVERITIES, 1))
_PHASES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(PHASES, 1))


@query("agg02_ranked_attack_types", "SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT coalesce(attack_type, 'unknown') AS label, count(*) AS n FROM incidents GROUP BY 1)")
def ranked_attack_types(spark, d):
    return overview.ranked(table(spark, d, "incidents"), F.col("attack_type"))


@query("agg03_severity_in_order", f"SELECT s.label, coalesce(c.n, 0) AS n, CAST(s.place AS BIGINT) AS place FROM (VALUES {_ORDER}) s(place, label) LEFT JOIN (SELECT severity AS label, count(*) AS n FROM incidents GROUP BY 1) c ON c.label = s.label")
def severity_in_order(spark, d):
    return overview.in_order(table(spark, d, "incidents"), "severity", SEVERITIES)


@query("agg04_incidents_by_year", "SELECT CAST(year(occurred_at) AS BIGINT) AS year, count(*) AS n FROM incidents WHERE occurred_at IS NOT NULL GROUP BY 1")
def incidents_by_year(spark, d):
    return overview.by_year(table(spark, d, "incidents"), "occurred_at")


@query("agg05_top_techniques", "SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT technique AS label, count(*) AS n FROM facts GROUP BY 1 ORDER BY n DESC, label LIMIT 10)")
def top_techniques(spark, d):
    lists = table(spark, d, "facts").groupBy("incident_id").agg(F.collect_list("technique").alias("techniques"))
    return overview.ranked(lists.select(F.explode("techniques").alias("t")), F.col("t"), 10)


@query("agg06_first_technique_of_rank", "SELECT rank, arg_min(technique, incident_id * 100 + ord) AS technique FROM facts GROUP BY rank")
def first_technique_of_rank(spark, d):
    return overview.first_label(table(spark, d, "facts"), "rank", "technique", F.col("incident_id") * 100 + F.col("ord"))


@query(
    "agg07_action_effectiveness",
    "SELECT action, mean, times_used, row_number() OVER (ORDER BY mean DESC, times_used DESC, action) AS place FROM (SELECT lower(trim(action)) AS action, round(avg(effectiveness), 4) AS mean, count(*) AS times_used FROM actions GROUP BY 1 HAVING avg(effectiveness) IS NOT NULL ORDER BY mean DESC, times_used DESC, action LIMIT 8)",
)
def effectiveness(spark, d):
    return overview.action_effectiveness(table(spark, d, "actions"))


@query(
    "agg08_key_figures",
    "SELECT * FROM (SELECT count(*) AS incidents, count(*) FILTER (WHERE provenance = 'shared') AS shared, CAST(sum(coalesce(redactions, 0)) AS BIGINT) AS redactions FROM incidents), (SELECT count(DISTINCT technique) AS techniques FROM facts), (SELECT count(*) AS actions FROM actions)",
)
def key_figures(spark, d):
    return overview.key_figures(table(spark, d, "incidents"), table(spark, d, "facts"), table(spark, d, "actions"))


@query("agg09_year_by_provenance", "SELECT CAST(year(occurred_at) AS BIGINT) AS year, provenance, count(*) AS n FROM incidents WHERE occurred_at IS NOT NULL GROUP BY 1, 2")
def year_by_provenance(spark, d):
    return overview.by_year(table(spark, d, "incidents"), "occurred_at", "provenance")


@query("agg09a_most_recent", "SELECT incident_id, row_number() OVER (ORDER BY occurred_at DESC NULLS LAST, incident_id) AS place FROM incidents QUALIFY place <= 12")
def most_recent(spark, d):
    return overview.most_recent(table(spark, d, "incidents").select("incident_id", "occurred_at"), "occurred_at", "incident_id", 12).select("incident_id", "place")


@query(
    "agg09b_first_of_phase",
    f"SELECT category, action, score, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, action) AS place FROM (SELECT category, lower(trim(action)) AS action, round(sum(coalesce(effectiveness, 0)), 4) AS score FROM actions GROUP BY 1, 2) WHERE category IN ({', '.join(repr(p) for p in PHASES)})) WHERE place <= 3",
)
def first_of_phase(spark, d):
    scores = table(spark, d, "actions").groupBy("category", F.lower(F.trim("action")).alias("action")).agg(F.round(F.sum(F.coalesce("effectiveness", F.lit(0))), 4).alias("score"))
    return overview.first_k_of_phase(scores).select("category", "action", "score", "place")


_BREAK = " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, 'unknown') AS label, count(*) AS n FROM incidents GROUP BY 2" for c in ("attack_type", "initial_vector", "severity", "provenance"))


@query("agg01_breakdowns_by_grouping_sets", _BREAK)
def breakdowns(spark, d):
    return overview.breakdowns(table(spark, d, "incidents"), ["attack_type", "initial_vector", "severity", "provenance"])


@query("agg10_cardinalities", "SELECT 'techniques' AS layer, count(DISTINCT technique) AS n FROM facts UNION ALL SELECT 'actions', count(DISTINCT lower(trim(action))) FROM actions UNION ALL SELECT 'incidents', count(*) FROM incidents UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def cardinalities(spark, d):
    facts, actions = table(spark, d, "facts"), table(spark, d, "actions")
    parts = [
        facts.agg(F.count_distinct("technique").alias("n")).select(F.lit("techniques").alias("layer"), "n"),
        actions.agg(F.count_distinct(F.lower(F.trim("action"))).alias("n")).select(F.lit("actions").alias("layer"), "n"),
        table(spark, d, "incidents").agg(F.count("*").alias("n")).select(F.lit("incidents").alias("layer"), "n"),
        table(spark, d, "supplier").agg(F.count("*").alias("n")).select(F.lit("suppliers").alias("layer"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("cat01_point_lookup", "SELECT incident_id, attack_type, severity FROM incidents WHERE incident_id = (SELECT max(incident_id) FROM incidents)")
def point_lookup(spark, d):
    rows = table(spark, d, "incidents").select("incident_id", "attack_type", "severity")
    return catalog.fetch(rows, rows.agg(F.max("incident_id").alias("incident_id")))


@query("cat02_filtered_page", "SELECT *, (SELECT count(*) FROM incidents WHERE attack_type = 'phishing' AND severity = 'high') AS total FROM (SELECT incident_id, attack_type, severity FROM incidents WHERE attack_type = 'phishing' AND severity = 'high' ORDER BY created_at DESC, incident_id LIMIT 20 OFFSET 5)")
def filtered_page(spark, d):
    rows = table(spark, d, "incidents").select("incident_id", "attack_type", "severity", "created_at")
    return catalog.page(rows, "phishing", "high", 20, 5).drop("created_at")


@query("cat03_fetch_by_ids", "SELECT i.incident_id, i.attack_type FROM (SELECT DISTINCT event_id * 7 AS incident_id FROM events) e JOIN incidents i USING (incident_id)")
def fetch_by_ids(spark, d):
    ids = table(spark, d, "events").select((F.col("event_id") * 7).alias("incident_id")).distinct()
    return catalog.fetch(table(spark, d, "incidents").select("incident_id", "attack_type"), ids)


@query("cat04_provenance_counts", "SELECT coalesce(provenance, 'internal') AS provenance, count(*) AS n FROM incidents GROUP BY 1")
def provenance_counts(spark, d):
    return table(spark, d, "incidents").groupBy(F.coalesce("provenance", F.lit("internal")).alias("provenance")).agg(F.count("*").alias("n"))


@query("cat05_public_projection", "SELECT incident_id, attack_type, initial_vector, severity FROM incidents ORDER BY embedding_text, incident_id")
def public_projection(spark, d):
    rows = catalog.public_view(table(spark, d, "incidents"))
    if set(rows.columns) & set(catalog.WITHHELD):
        raise ValueError("withheld columns in a public view")
    return rows.orderBy("embedding_text", "incident_id").select("incident_id", "attack_type", "initial_vector", "severity")


@query(
    "cat06_duplicate_shares",
    "SELECT n.incident_id FROM incidents n WHERE n.incident_id % 2 = 1 AND EXISTS (SELECT 1 FROM incidents s WHERE s.incident_id % 2 = 0 AND s.provenance = 'shared' AND s.embedding_text = n.embedding_text AND s.attack_type = n.attack_type AND s.severity = n.severity AND s.contributor_ref IS NOT DISTINCT FROM n.contributor_ref)",
)
def duplicate_shares(spark, d):
    rows = table(spark, d, "incidents")
    shared = rows.where("incident_id % 2 = 0 and provenance = 'shared'").select("embedding_text", "attack_type", "severity", "contributor_ref").distinct()
    return catalog.duplicates(shared, rows.where("incident_id % 2 = 1"), ["embedding_text", "attack_type", "severity"], "contributor_ref").select("incident_id")


@query("snk02_upsert_newest_version", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def newest_version(spark, d):
    return catalog.upsert(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).drop("ts")


@query("snk03_reindex", "SELECT incident_id, embedding_text FROM incidents WHERE embedding_text IS NOT NULL AND embedding_text <> ''")
def reindex(spark, d):
    return catalog.reindexable(table(spark, d, "incidents"))


@query("snk04_cascade_delete", "SELECT 'parents' AS part, count(*) AS n FROM incidents WHERE incident_id % 10 <> 3 UNION ALL SELECT 'children', count(*) FROM actions WHERE incident_id % 10 <> 3")
def cascade_delete(spark, d):
    rows = table(spark, d, "incidents")
    parents, children = catalog.cascade_delete(rows, table(spark, d, "actions"), rows.where("incident_id % 10 = 3").select("incident_id"))
    return parents.agg(F.count("*").alias("n")).select(F.lit("parents").alias("part"), "n").union(children.agg(F.count("*").alias("n")).select(F.lit("children"), "n"))


@query("snk05_append_children", "SELECT n.incident_id, n.ord, row_number() OVER (PARTITION BY n.incident_id ORDER BY n.ord) - 1 + coalesce(c.taken, 0) AS position FROM facts n LEFT JOIN (SELECT incident_id, count(*) AS taken FROM actions WHERE position <= 3 GROUP BY 1) c USING (incident_id) WHERE n.ord > 3")
def append_children(spark, d):
    new = table(spark, d, "facts").where("ord > 3").select("incident_id", "ord")
    return catalog.append_children(table(spark, d, "actions").where("position <= 3"), new, order="ord")


@query("snk07_schema_migration", "SELECT incident_id, attack_type, CASE WHEN incident_id % 2 = 0 THEN severity END AS severity FROM incidents")
def schema_migration(spark, d):
    rows = table(spark, d, "incidents")
    return catalog.migrate(rows.where("incident_id % 2 = 0").select("incident_id", "attack_type", "severity"), rows.where("incident_id % 2 <> 0").select("incident_id", "attack_type"))


@query("prv16_same_contributor", "SELECT count(*) AS same FROM incidents a JOIN actions b USING (incident_id) WHERE a.contributor_ref = b.position")
def same_contributor(spark, d):
    pairs = table(spark, d, "incidents").join(table(spark, d, "actions"), "incident_id")
    return pairs.where(catalog.same_contributor(F.col("contributor_ref"), F.col("position"))).agg(F.count("*").alias("same"))


@query("prv18_month_coarsening", "SELECT CAST(year(m) * 100 + month(m) AS BIGINT) AS month, count(*) AS n FROM (SELECT date_trunc('month', created_at) AS m FROM incidents WHERE provenance = 'shared') GROUP BY 1")
def month_coarsening(spark, d):
    month = F.date_trunc("month", "created_at")
    return table(spark, d, "incidents").where("provenance = 'shared'").groupBy((F.year(month) * 100 + F.month(month)).cast("long").alias("month")).agg(F.count("*").alias("n"))


@query("src05_json_corpus", "SELECT conv_id AS incident_id, turn AS position, role AS category, text AS action, 'synthetic' AS provenance FROM conversations")
def json_corpus(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("position"), F.col("role").alias("category"), F.col("text").alias("action"))).alias("mitigations"))
    documents = rows.select(F.to_json(F.struct(F.array(F.struct(F.col("conv_id").alias("incident_id"), "mitigations")).alias("incidents"))).alias("value"))
    return corpora.parse_corpus(documents, "synthetic")


@query("src09_stix_relationships", "SELECT concat('M', CAST(l_suppkey AS VARCHAR)) AS control, concat('T', CAST(1000 + l_partkey % 60 AS VARCHAR)) AS technique FROM lineitem WHERE l_suppkey % 7 <> 0 AND l_partkey % 60 % 9 <> 0 GROUP BY 1, 2")
def stix_relationships(spark, d):
    return corpora.controls_of(_bundle(spark, d))


@query("src10_stix_techniques", "SELECT DISTINCT concat('T', CAST(1000 + p_partkey % 60 AS VARCHAR)) AS technique, concat('technique ', CAST(p_partkey % 60 AS VARCHAR)) AS name FROM part WHERE p_partkey % 60 % 9 <> 0")
def stix_techniques(spark, d):
    return corpora.techniques(_bundle(spark, d)).select("technique", "name")


def _bundle(spark, d):
    """Threat-knowledge objects made of parts (techniques), suppliers (controls) and line items (edges)."""
    ref = lambda kind, key: F.concat(F.lit(kind + "--"), key.cast("string"))
    empty = F.lit(None).cast("string")
    node = lambda df, kind, key, code, revoked, name: df.select(
        ref(kind, key).alias("id"), F.lit(kind).alias("type"), name.alias("name"), revoked.alias("revoked"), F.array(F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id")), F.struct(F.lit(corpora.SOURCE).alias("source_name"), code.alias("external_id"))).alias("external_references"), empty.alias("relationship_type"), empty.alias("source_ref"), empty.alias("target_ref")
    ).distinct()
    k = F.col("p_partkey") % 60
    part = node(table(spark, d, "part"), "attack-pattern", k, F.concat(F.lit("T"), (k + 1000).cast("string")), k % 9 == 0, F.concat(F.lit("technique "), k.cast("string")))
    s = F.col("s_suppkey")
    supplier = node(table(spark, d, "supplier"), "course-of-action", s, F.concat(F.lit("M"), s.cast("string")), s % 7 == 0, F.col("s_name"))
    edges = table(spark, d, "lineitem").select(
        F.concat_ws("-", F.lit("relationship-"), "l_orderkey", "l_linenumber").alias("id"), F.lit("relationship").alias("type"), empty.alias("name"), F.lit(False).alias("revoked"), F.lit(None).cast(part.schema["external_references"].dataType).alias("external_references"), F.lit("mitigates").alias("relationship_type"), ref("course-of-action", F.col("l_suppkey")).alias("source_ref"), ref("attack-pattern", F.col("l_partkey") % 60).alias("target_ref")
    )
    return part.union(supplier).union(edges)


def _threats(spark, d):
    """Threat-knowledge objects: nations are groups, suppliers malware and tools, regions campaigns; line items say who uses what, and in which words."""
    code = lambda letter, key: F.array(F.struct(F.lit(corpora.SOURCE).alias("source_name"), F.concat(F.lit(letter), key.cast("string")).alias("external_id")))
    ref = lambda kind, key: F.concat(F.lit(kind + "--"), key.cast("string"))
    n, s, r, k = F.col("n_nationkey"), F.col("s_suppkey"), F.col("r_regionkey"), F.col("p_partkey") % 60
    node = lambda df, kind, key, letter, number, name, text, revoked, old: df.select(ref(kind, key).alias("id"), F.lit(kind).alias("type"), name.alias("name"), text.alias("description"), revoked.alias("revoked"), old.alias("x_mitre_deprecated"), code(letter, number).alias("external_references")).distinct()
    no, label = F.lit(False), F.concat(F.lit("technique "), k.cast("string"))
    suppliers = table(spark, d, "supplier")
    parts = [
        node(table(spark, d, "part"), "attack-pattern", k, "T", k + 1000, label, label, k % 9 == 0, k % 13 == 1),
        node(table(spark, d, "nation"), "intrusion-set", n, "G", n, F.col("n_name"), F.repeat(F.col("n_name"), F.lit(100)), n % 11 == 0, n % 13 == 5),
        node(suppliers.where(s % 2 == 0), "malware", s, "S", s, F.col("s_name"), F.col("s_name"), no, s % 17 == 0),
        node(suppliers.where(s % 2 == 1), "tool", s, "S", s, F.col("s_name"), F.col("s_name"), no, s % 17 == 0),
        node(table(spark, d, "region"), "campaign", r, "C", r, F.col("r_name"), F.col("r_name"), no, no),
    ]
    lines = table(spark, d, "lineitem")
    told = F.concat(F.lit("[Thing](https://x.org/a) used <code>"), F.lower("l_linestatus"), F.lit("</code>  to act(Citation: some one) "), F.when(F.col("l_linenumber") > 2, F.lower("l_returnflag")).otherwise(""))
    used = F.col("l_partkey") % 60
    edge = lambda df, kind, left, right, text, gone: df.select(F.lit("relationship").alias("type"), F.lit(kind).alias("relationship_type"), left.alias("source_ref"), right.alias("target_ref"), text.alias("description"), gone.alias("revoked"))
    gone = F.col("l_linenumber") == 7
    malware = F.when(F.col("l_suppkey") % 2 == 0, ref("malware", F.col("l_suppkey"))).otherwise(ref("tool", F.col("l_suppkey")))
    parts += [
        edge(lines, "uses", ref("intrusion-set", F.col("l_suppkey") % 25), ref("attack-pattern", used), told, gone),
        edge(lines, "uses", malware, ref("attack-pattern", used), F.when(F.col("l_linenumber") < 4, "too short").otherwise(told), gone),
        edge(lines.where("l_suppkey % 10 = 3"), "uses", ref("campaign", F.col("l_suppkey") % 4), ref("attack-pattern", used), told, gone),
        edge(table(spark, d, "nation").where("n_regionkey < 3"), "attributed-to", ref("campaign", F.col("n_regionkey")), ref("intrusion-set", n), F.lit(None).cast("string"), F.lit(False)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


_TECH = "tech AS (SELECT DISTINCT k, 'T' || (1000 + k) AS technique FROM (SELECT p_partkey % 60 AS k FROM part) WHERE k % 9 <> 0 AND k % 13 <> 1), used AS (SELECT l_suppkey AS s, technique, l_linenumber, l_linestatus, l_returnflag FROM lineitem JOIN tech ON k = l_partkey % 60 WHERE l_linenumber <> 7)"
_LISTED = "string_agg(DISTINCT technique, ',' ORDER BY technique)"


@query("src09_groups", f"WITH {_TECH} SELECT 'G' || n_nationkey AS code, n_name AS name, CASE WHEN length(repeat(n_name, 100)) <= 400 THEN repeat(n_name, 100) ELSE left(repeat(n_name, 100), 400) || '...' END AS description, {_LISTED} AS techniques FROM nation JOIN used ON s % 25 = n_nationkey WHERE n_nationkey % 11 <> 0 AND n_nationkey % 13 <> 5 GROUP BY n_nationkey, n_name")
def bundle_groups(spark, d):
    return corpora.groups(_threats(spark, d)).select("code", "name", "description", F.array_join("techniques", ",").alias("techniques"))


@query("src09_software", f"WITH {_TECH} SELECT 'S' || s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'malware' ELSE 'tool' END AS kind, {_LISTED} AS techniques FROM supplier JOIN used ON s = s_suppkey WHERE s_suppkey % 17 <> 0 GROUP BY s_suppkey")
def bundle_software(spark, d):
    return corpora.software(_threats(spark, d)).select("code", "kind", F.array_join("techniques", ",").alias("techniques"))


@query("src09_campaigns", f"WITH {_TECH} SELECT 'C' || r_regionkey AS code, r_name AS name, replace(o.ref, 'intrusion-set--', 'G') AS attributed_to, n.n_name AS attributed_to_name, coalesce(t.techniques, '') AS techniques FROM region LEFT JOIN (SELECT n_regionkey, max('intrusion-set--' || n_nationkey) AS ref FROM nation WHERE n_regionkey < 3 GROUP BY 1) o ON o.n_regionkey = r_regionkey LEFT JOIN nation n ON 'intrusion-set--' || n.n_nationkey = o.ref LEFT JOIN (SELECT s % 4 AS c, {_LISTED} AS techniques FROM used WHERE s % 10 = 3 GROUP BY 1) t ON t.c = r_regionkey")
def bundle_campaigns(spark, d):
    return corpora.campaigns(_threats(spark, d)).select("code", "name", "attributed_to", "attributed_to_name", F.array_join("techniques", ",").alias("techniques"))


_SAID = "trim('Thing used ' || lower(l_linestatus) || ' to act ' || CASE WHEN l_linenumber > 2 THEN lower(l_returnflag) ELSE '' END)"


@query("src12_bundle_examples", f"WITH {_TECH}, said AS (SELECT DISTINCT technique, 'G' || n_nationkey AS source, n_name AS name, {_SAID} AS sentence FROM used JOIN nation ON n_nationkey = s % 25 WHERE n_nationkey % 11 <> 0 AND n_nationkey % 13 <> 5 UNION ALL SELECT DISTINCT technique, 'S' || s_suppkey, s_name, {_SAID} FROM used JOIN supplier ON s_suppkey = s WHERE s_suppkey % 17 <> 0 AND l_linenumber >= 4 UNION ALL SELECT DISTINCT technique, 'C' || r_regionkey, r_name, {_SAID} FROM used JOIN region ON r_regionkey = s % 4 WHERE s % 10 = 3) SELECT row_number() OVER (ORDER BY technique, source, name, sentence) AS ordinal, * FROM said")
def bundle_examples(spark, d):
    return corpora.bundle_examples(_threats(spark, d))


@query("snk01_memory_after_deletion", f"SELECT term, count(*) AS df FROM (SELECT incident_id, unnest(list_distinct({_sql_tokens('embedding_text')})) AS term FROM incidents WHERE embedding_text <> '' AND incident_id % 9 <> 0) GROUP BY 1")
def memory_after_deletion(spark, d):
    """All incidents and actions are committed to a store, a ninth deleted; the memory's document frequencies follow without a rebuild."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    kept = store.Store(spark, root)
    kept.add(table(spark, d, "incidents").select("incident_id", "embedding_text", "provenance"), table(spark, d, "actions"))
    kept.delete(table(spark, d, "incidents").where("incident_id % 9 = 0").select("incident_id"))
    return kept.frequencies()


@query("src11_keyed_catalogue", "SELECT user_id AS cve, event_type AS vendor FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def keyed_catalogue(spark, d):
    return corpora.keyed(table(spark, d, "events").select(F.col("user_id").alias("cve"), F.col("event_type").alias("vendor"), F.col("event_id").alias("ordinal")), "cve", "ordinal")


@query("src14_line_list", "SELECT doc_id, line, 'contain' AS category FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE length(line) >= 3")
def line_list(spark, d):
    return corpora.line_actions(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.col("action").alias("line"), "category")


@query("src04_reader_dispatch", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'text' WHEN doc_id % 5 = 2 THEN 'docx' WHEN doc_id % 5 = 3 THEN 'pdf' END AS reader, CASE WHEN doc_id % 5 = 4 THEN 'unreadable: .exe' END AS error FROM documents")
def reader_dispatch(spark, d):
    from ..sources.reports import dispatch

    kind = F.element_at(F.array(*map(F.lit, ["txt", "MD", "docx", "pdf", "exe"])), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/report."), kind).alias("path"))
    return dispatch(rows, "path").select("doc_id", "reader", "error")


@query("src01_text_reader", "SELECT doc_id, text FROM documents")
def text_reader(spark, d):
    from ..sources.reports import decode

    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8"))).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", decode(raw).alias("text"))


@query(
    "snk06_markdown_report",
    "SELECT incident_id, concat('# Incident ', CAST(incident_id AS VARCHAR), chr(10), chr(10), '| Field | Value |', chr(10), '| --- | --- |', chr(10), '| Type | ', coalesce(attack_type, 'unknown'), ' |', chr(10), '| Entry | ', initial_vector, ' |', chr(10), '| Severity | ', coalesce(severity, 'unknown'), ' |') AS report FROM incidents",
)
def markdown_report(spark, d):
    from ..sources.sinks import markdown

    return table(spark, d, "incidents").select("incident_id", markdown(F.col("incident_id"), {"Type": F.col("attack_type"), "Entry": F.col("initial_vector"), "Severity": F.col("severity")}).alias("report"))
