"""Response, resemblance, tabletop and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import family
from ..operators import actions as act
from ..operators import memory, resemblance, tabletop
from .registry import query, table
from .search_queries import _ASKED, _COUNTS, _TOP, _scores

# Every incident asks; its matches are the next four incidents, less similar one by one.
_MATCHES = "m AS (SELECT q.incident_id AS query, i.incident_id, 1 / (1 + (i.incident_id - q.incident_id) * 0.37::DOUBLE) AS similarity, i.incident_id - q.incident_id AS place FROM incidents q JOIN (SELECT incident_id FROM incidents) i ON i.incident_id BETWEEN q.incident_id + 1 AND q.incident_id + 4)"


def _matches(spark, d):
    asked = table(spark, d, "incidents").select(F.col("incident_id").alias("query"))
    near = asked.select("query", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("place"))
    near = near.select("query", (F.col("query") + F.col("place")).alias("incident_id"), (1 / (1 + F.col("place") * 0.37)).alias("similarity"), F.col("place").cast("long").alias("place"))
    return near.join(table(spark, d, "incidents").select("incident_id"), "incident_id", "left_semi")


_ROLL = f"{_MATCHES}, r AS (SELECT query, lower(trim(action)) AS key, sum(similarity * coalesce(effectiveness, 0.6::DOUBLE)) AS weight, count(*) AS times_used, round(avg(effectiveness), 4) AS mean, count(DISTINCT incident_id) AS sources, arg_min(trim(action), place * 100 + position) AS action, arg_min(category, place * 100 + position) AS category FROM m JOIN actions USING (incident_id) GROUP BY 1, 2), rolled AS (SELECT query, key, times_used, mean, sources, action, category, round(weight * (1 + 0.15::DOUBLE * (times_used - 1)), 4) AS score FROM r), top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM rolled QUALIFY place <= 12)"


def _rolled(spark, d):
    return act.roll_up(_matches(spark, d), table(spark, d, "actions"))


@query("agg11_action_roll_up", f"WITH {_ROLL} SELECT * FROM top")
def action_roll_up(spark, d):
    return _rolled(spark, d)


_EDGES = "edges AS (SELECT DISTINCT 'M' || (p_partkey % 17) AS control, 'T' || (1000 + p_partkey % 60) || CASE WHEN p_partkey % 4 = 0 THEN '.001' ELSE '' END AS technique FROM part)"


def _edges(spark, d):
    k = F.col("p_partkey")
    technique = F.concat(F.lit("T"), (k % 60 + 1000).cast("string"), F.when(k % 4 == 0, ".001").otherwise(""))
    return table(spark, d, "part").select(F.concat(F.lit("M"), (k % 17).cast("string")).alias("control"), technique.alias("technique")).distinct()


def _observed(spark, d):
    return table(spark, d, "facts").select(F.col("incident_id").alias("query"), "technique")


@query("agg12_coverage", f"WITH {_EDGES}, seen AS (SELECT DISTINCT incident_id AS query, technique FROM facts), c AS (SELECT query, technique, control FROM seen JOIN edges USING (technique) UNION ALL SELECT query, s.technique, e.control FROM seen s JOIN edges e ON e.technique = split_part(s.technique, '.', 1) WHERE contains(s.technique, '.') AND s.technique NOT IN (SELECT technique FROM edges)), n AS (SELECT query, control, count(DISTINCT technique) AS covers, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques FROM c GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query ORDER BY covers DESC, control) AS place FROM n QUALIFY place <= 10")
def coverage(spark, d):
    return act.coverage(_observed(spark, d), _edges(spark, d))


@query("jn03_technique_controls", f"WITH {_EDGES} SELECT technique, count(DISTINCT control) AS controls FROM (SELECT technique FROM facts GROUP BY 1) JOIN edges USING (technique) GROUP BY 1")
def technique_controls(spark, d):
    return table(spark, d, "facts").select("technique").distinct().join(_edges(spark, d), "technique").groupBy("technique").agg(F.count_distinct("control").alias("controls"))


@query("jn02_parent_fallback", f"WITH {_EDGES}, n AS (SELECT technique, min(control) AS control FROM edges GROUP BY 1) SELECT t.technique, coalesce(a.control, b.control) AS control FROM (SELECT DISTINCT technique FROM facts) t LEFT JOIN n a ON a.technique = t.technique LEFT JOIN n b ON b.technique = split_part(t.technique, '.', 1)")
def parent_fallback(spark, d):
    names = _edges(spark, d).groupBy("technique").agg(F.min("control").alias("control"))
    own = table(spark, d, "facts").select("technique").distinct()
    parents = names.select(F.col("technique").alias("parent"), F.col("control").alias("inherited"))
    return own.join(names, "technique", "left").withColumn("parent", family(F.col("technique"))).join(parents, "parent", "left").select("technique", F.coalesce("control", "inherited").alias("control"))


_BASE = "base AS (SELECT DISTINCT 'T' || (1000 + p_partkey % 60) || CASE WHEN p_partkey % 7 = 0 THEN '.002' ELSE '' END AS technique, 'Action ' || (p_partkey % 40) AS action FROM part)"


def _baseline(spark, d):
    k = F.col("p_partkey")
    technique = F.concat(F.lit("T"), (k % 60 + 1000).cast("string"), F.when(k % 7 == 0, ".002").otherwise(""))
    return table(spark, d, "part").select(technique.alias("technique"), F.concat(F.lit("Action "), (k % 40).cast("string")).alias("action")).distinct()


@query("jn10_gap_fill", f"WITH {_ROLL}, {_BASE}, seen AS (SELECT DISTINCT incident_id AS query, technique FROM facts), s AS (SELECT technique, query, action FROM seen JOIN base USING (technique) UNION ALL SELECT s.technique, s.query, b.action FROM seen s JOIN base b ON b.technique = split_part(s.technique, '.', 1) WHERE contains(s.technique, '.') AND s.technique NOT IN (SELECT technique FROM base)) SELECT query, min(technique) AS for_technique, arg_min(action, technique || action) AS action FROM s WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query = s.query AND lower(trim(t.action)) = lower(s.action)) GROUP BY query, lower(action)")
def gap_fill(spark, d):
    return act.gap_fill(_observed(spark, d), _baseline(spark, d), _rolled(spark, d))


_PHASE = "CASE category WHEN 'detect' THEN 1 WHEN 'contain' THEN 2 WHEN 'eradicate' THEN 3 WHEN 'recover' THEN 4 WHEN 'harden' THEN 5 ELSE 99 END"


@query("agg13_actions_by_phase", f"SELECT CAST(phase_no AS BIGINT) AS phase_no, count(*) AS n FROM (SELECT {_PHASE} AS phase_no FROM actions) WHERE phase_no < 99 GROUP BY 1")
def actions_by_phase(spark, d):
    return act.by_phase(table(spark, d, "actions")).groupBy("phase_no").agg(F.count("*").alias("n"))


@query("rnk11_phase_then_score", f"WITH {_ROLL} SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY {_PHASE}, score DESC, key) AS place FROM top")
def phase_then_score(spark, d):
    from pyspark.sql import Window

    rows = act.by_phase(_rolled(spark, d), keep_unknown=True)
    return rows.select("query", "key", F.row_number().over(Window.partitionBy("query").orderBy("phase_no", F.desc("score"), "key")).cast("long").alias("place"))


@query("rnk16_what_worked", f"WITH {_ROLL}, a AS (SELECT query, action, score, place % 2 = 0 AND query % 20 = 1 AS recalled FROM top), b AS (SELECT *, bool_or(recalled) OVER (PARTITION BY query) AS any_recalled FROM a) SELECT query, action, score, recalled, row_number() OVER (PARTITION BY query ORDER BY score DESC, action) AS place FROM b WHERE recalled OR NOT any_recalled QUALIFY place <= 5")
def what_worked(spark, d):
    rows = _rolled(spark, d).select("query", "action", "score", ((F.col("place") % 2 == 0) & (F.col("query") % 20 == 1)).alias("recalled"))
    return act.what_worked(rows)


@query("rnk17_same_entry", f"WITH {_MATCHES}, v AS (SELECT incident_id, initial_vector FROM incidents) SELECT query, incident_id, initial_vector, round(similarity, 6) AS similarity, n AS place FROM (SELECT m.query, m.incident_id, a.initial_vector, m.similarity, row_number() OVER (PARTITION BY m.query ORDER BY m.similarity DESC, m.incident_id) AS n FROM m JOIN v a ON a.incident_id = m.incident_id JOIN v b ON b.incident_id = m.query AND b.initial_vector = a.initial_vector AND b.initial_vector <> 'unknown') WHERE n <= 3")
def same_entry(spark, d):
    vectors = table(spark, d, "incidents").select("incident_id", "initial_vector")
    matches = _matches(spark, d).drop("place").join(vectors, "incident_id")
    return act.same_entry(vectors.withColumnRenamed("incident_id", "query"), matches).select("query", "incident_id", "initial_vector", F.round("similarity", 6).alias("similarity"), "place")


@query("rnk18_top_two_actions", "SELECT incident_id, position, row_number() OVER (PARTITION BY incident_id ORDER BY coalesce(effectiveness, 0) DESC, position) AS place FROM actions QUALIFY place <= 2")
def top_two_actions(spark, d):
    rows = table(spark, d, "actions").select(F.col("incident_id").alias("query"), F.col("position").alias("doc"), F.coalesce("effectiveness", F.lit(0.0)).alias("score"))
    return memory.top_k(rows, 2).select(F.col("query").alias("incident_id"), F.col("doc").alias("position"), "place")


_NEXT = f"{_MATCHES}, far AS (SELECT incident_id AS query, max(rank) AS far FROM facts WHERE ord <= 2 GROUP BY 1), later AS (SELECT m.query, f.rank, 'stage ' || f.rank AS stage, count(DISTINCT f.incident_id) AS n FROM m JOIN facts f USING (incident_id) JOIN far ON far.query = m.query WHERE f.rank > far.far GROUP BY 1, 2), few AS (SELECT * FROM later QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, rank) <= 4)"


@query("agg15_next_steps", f"WITH {_NEXT} SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM few")
def next_steps(spark, d):
    facts = table(spark, d, "facts")
    stages = _matches(spark, d).select("query", "incident_id").join(facts, "incident_id").select("query", "incident_id", "rank", F.concat(F.lit("stage "), F.col("rank").cast("string")).alias("stage"))
    return act.next_steps(facts.where("ord <= 2").select(F.col("incident_id").alias("query"), "rank"), stages)


@query("agg16_stage_examples", f"WITH {_MATCHES}, e AS (SELECT m.query, f.rank, f.technique, min(m.place * 100 + f.ord) AS o FROM m JOIN facts f USING (incident_id) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY m.query, f.rank ORDER BY o, f.technique) <= 3) SELECT query, rank, string_agg(technique, ',' ORDER BY o, technique) AS examples FROM e GROUP BY 1, 2")
def stage_examples(spark, d):
    rows = _matches(spark, d).join(table(spark, d, "facts"), "incident_id")
    return act.examples(rows, ["query", "rank"], "technique", ["place", "ord"])


_PROFILES = "profiles AS (SELECT DISTINCT l_suppkey AS profile, 'T' || (1000 + (l_suppkey * 7 + l_linenumber * 11) % 60) AS technique FROM lineitem), df AS (SELECT technique, ln(((SELECT count(DISTINCT profile) FROM profiles) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS weight FROM profiles GROUP BY 1)"


def _profiles(spark, d):
    """Profiles of published groups: one for each supplier."""
    group = F.col("l_suppkey")
    technique = F.concat(F.lit("T"), ((group * 7 + F.col("l_linenumber") * 11) % 60 + 1000).cast("string"))
    return table(spark, d, "lineitem").select(group.alias("profile"), technique.alias("technique")).distinct()


def _families(spark, d):
    return table(spark, d, "facts").select(F.col("incident_id").alias("query"), family(F.col("technique")).alias("technique"))


@query("rnk10_specificity", f"WITH {_PROFILES} SELECT technique, round(weight, 6) AS weight FROM df", ctes=False)
def specificity(spark, d):
    return resemblance.specificity(_profiles(spark, d)).withColumn("weight", F.round("weight", 6))


_RESEMBLE = f"{_PROFILES}, seen AS (SELECT s.query, s.technique, coalesce(df.weight, 1.0::DOUBLE) AS weight FROM (SELECT DISTINCT incident_id AS query, split_part(technique, '.', 1) AS technique FROM facts) s LEFT JOIN df USING (technique)), hit AS (SELECT query, profile, count(*) AS shared, sum(weight) AS part FROM seen JOIN profiles USING (technique) GROUP BY 1, 2 HAVING count(*) >= 2), cov AS (SELECT query, profile, shared, round(part / whole, 4) AS coverage FROM hit JOIN (SELECT query, sum(weight) AS whole FROM seen GROUP BY 1) USING (query)), near AS (SELECT query, profile, shared, coverage, CASE WHEN coverage >= 0.75 THEN 'notable' WHEN coverage >= 0.5 THEN 'moderate' ELSE 'weak' END AS band, row_number() OVER (PARTITION BY query ORDER BY coverage DESC, shared DESC, profile) AS place FROM cov WHERE coverage >= 0.30 QUALIFY place <= 3)"


@query("rnk10_resemblance", f"WITH {_RESEMBLE} SELECT * FROM near")
def resemble(spark, d):
    return resemblance.resemblance(_families(spark, d), _profiles(spark, d))


@query("jn09_campaigns_of_matches", f"WITH {_RESEMBLE} SELECT n_nationkey AS campaign, profile AS \"group\", n_nationkey AS ordinal FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(s_suppkey AS BIGINT) AS profile FROM nation JOIN supplier ON s_suppkey % 25 = n_nationkey) WHERE profile IN (SELECT profile FROM near) ORDER BY n_nationkey, campaign, profile LIMIT 5")
def campaigns(spark, d):
    matched = resemblance.resemblance(_families(spark, d), _profiles(spark, d)).select(F.col("profile").alias("group"))
    rows = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_suppkey") % 25 == F.col("n_nationkey"))
    rows = rows.select(F.col("n_nationkey").cast("long").alias("campaign"), F.col("s_suppkey").cast("long").alias("group"), F.col("n_nationkey").cast("long").alias("ordinal"))
    return resemblance.campaigns_of(matched, rows)


@query("sim01_injects", "SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY rank) AS place, rank, techniques, CASE WHEN rank % 2 = 0 THEN 'prompt ' || rank ELSE 'What do you know, and whom do you tell?' END AS prompt FROM (SELECT doc, rank, string_agg(technique, ',' ORDER BY technique) AS techniques FROM (SELECT DISTINCT incident_id AS doc, rank, technique FROM facts QUALIFY dense_rank() OVER (PARTITION BY doc, rank ORDER BY technique) <= 2) GROUP BY 1, 2)")
def injects(spark, d):
    return tabletop.injects(_doc_facts(spark, d), _prompts(spark))


def _doc_facts(spark, d):
    return table(spark, d, "facts").select(F.col("incident_id").alias("doc"), "rank", "technique")


def _prompts(spark):
    return spark.range(0, 14, 2).select(F.col("id").alias("rank"), F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"))


@query("sim02_headline", "SELECT doc, arg_min(technique, k) AS technique FROM (SELECT incident_id AS doc, technique, CASE WHEN rank = 2 THEN '0' ELSE '1' END || lpad(CAST(rank AS VARCHAR), 2, '0') || technique AS k FROM facts) GROUP BY 1")
def headline(spark, d):
    return tabletop.headline(_doc_facts(spark, d), 2)


@query("sim03_headline_controls", "SELECT incident_id AS doc, array_to_string(CASE WHEN len(c) = 0 THEN ['Review logging and access'] ELSE c[1:4] END, '; ') AS controls FROM (SELECT incident_id, list_filter([CASE WHEN bool_or(technique IN ('T1001', 'T1002.001', 'T1010')) THEN 'Reset accounts' END, CASE WHEN bool_or(technique IN ('T1020', 'T1030', 'T1040')) THEN 'Isolate hosts' END, CASE WHEN bool_or(technique IN ('T1050', 'T1004.003')) THEN 'Block egress' END], lambda x: x IS NOT NULL) AS c FROM facts GROUP BY 1)")
def headline_controls(spark, d):
    rules = [(["T1001", "T1002.001", "T1010"], "Reset accounts"), (["T1020", "T1030", "T1040"], "Isolate hosts"), (["T1050", "T1004.003"], "Block egress")]
    sets = _doc_facts(spark, d).groupBy("doc").agg(F.collect_set("technique").alias("t"))
    return sets.select("doc", F.array_join(tabletop.controls(F.col("t"), rules), "; ").alias("controls"))


@query("sim04_duration", "SELECT incident_id AS doc, least(30 + 10 * count(DISTINCT rank), 120) AS minutes FROM facts GROUP BY 1")
def durations(spark, d):
    return _doc_facts(spark, d).groupBy("doc").agg(F.count_distinct("rank").alias("n")).select("doc", tabletop.duration(F.col("n")).alias("minutes"))


@query("qa02_answers", f"WITH {_COUNTS}, {_ASKED}, best AS ({_TOP}6), told AS (SELECT query, count(*) AS sources, string_agg('- document ' || doc || ' (' || lang || ')', chr(10) ORDER BY place) AS digest FROM best JOIN documents ON doc_id = doc WHERE score >= 0.10 GROUP BY 1) SELECT item_id AS query, coalesce(sources, 0) AS sources, coalesce(digest, 'The memory holds nothing on this.') AS answer FROM benchmark LEFT JOIN told ON query = item_id", ctes=False)
def answers(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"))
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" ("), "lang", F.lit(")")).alias("title"))
    return tabletop.answers(asked, memory.top_k(_scores(spark, d), 6), titles)


_CLAIMS = "SELECT query, list_sort(list(DISTINCT technique)) AS retrieved FROM m JOIN facts USING (incident_id) GROUP BY 1"


@query("qa03_citation_check", f"WITH {_MATCHES}, r AS ({_CLAIMS}), c AS (SELECT incident_id AS query, list(DISTINCT technique) AS claimed FROM facts GROUP BY 1) SELECT query, array_to_string(list_sort(list_intersect(claimed, coalesce(retrieved, []))), ',') AS verified, CAST(len(claimed) - len(list_intersect(claimed, coalesce(retrieved, []))) AS BIGINT) AS unsupported FROM c LEFT JOIN r USING (query)")
def citation_check(spark, d):
    """Claims of each question against the rows that were retrieved for it."""
    facts = table(spark, d, "facts")
    found = _matches(spark, d).join(facts, "incident_id").groupBy("query").agg(F.collect_set("technique").alias("retrieved"))
    claims = facts.groupBy(F.col("incident_id").alias("query")).agg(F.collect_set("technique").alias("claimed"))
    yes, no = tabletop.check_citations(F.col("claimed"), F.coalesce("retrieved", F.array().cast("array<string>")))
    return claims.join(found, "query", "left").select("query", F.array_join(F.array_sort(yes), ",").alias("verified"), F.size(no).cast("long").alias("unsupported"))


_TOP_ACTIONS = "SELECT incident_id, string_agg('    - [' || category || '] ' || trim(action) || CASE WHEN effectiveness IS NULL THEN '' ELSE ' (effectiveness ' || CAST(round(effectiveness * 100) AS BIGINT) || '%)' END, chr(10) ORDER BY position, trim(action), category, effectiveness NULLS FIRST) AS done FROM (SELECT * FROM actions WHERE trim(action) <> '' QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY position, trim(action), category, effectiveness NULLS FIRST) <= 8) GROUP BY 1"
_NAMES = "SELECT incident_id, string_agg(technique, ', ' ORDER BY technique) AS techniques FROM (SELECT DISTINCT incident_id, technique FROM facts QUALIFY dense_rank() OVER (PARTITION BY incident_id ORDER BY technique) <= 8) GROUP BY 1"


@query("qa04_context", f"SELECT i.incident_id, 'INCIDENT ' || i.incident_id || chr(10) || '  Date: ' || coalesce(strftime(occurred_at, '%Y-%m-%d'), 'undated') || chr(10) || '  Type: ' || coalesce(attack_type, 'unknown') || ' | Entry vector: ' || initial_vector || ' | Severity: ' || coalesce(severity, 'unknown') || chr(10) || '  Techniques: ' || coalesce(techniques, 'none recorded') || chr(10) || '  Response actions taken:' || chr(10) || coalesce(done, '    - none recorded') AS context FROM incidents i LEFT JOIN ({_TOP_ACTIONS}) a USING (incident_id) LEFT JOIN ({_NAMES}) t USING (incident_id)")
def context(spark, d):
    incidents = table(spark, d, "incidents").withColumn("occurred_at", F.date_format("occurred_at", "yyyy-MM-dd"))
    return tabletop.context(incidents, table(spark, d, "facts"), table(spark, d, "actions").withColumn("action", F.trim("action")).where("action <> ''"))


@query("sim04_success_criteria", "SELECT incident_id AS doc, CAST(3 + CASE WHEN bool_or(rank = 13) THEN 1 ELSE 0 END + CASE WHEN bool_or(rank = 12) THEN 1 ELSE 0 END + CASE WHEN bool_or(rank = 5) THEN 1 ELSE 0 END AS INTEGER) AS criteria, 'Each of the ' || count(DISTINCT rank) || ' phases is detected by a rule, or the gap is logged.' AS first FROM facts GROUP BY 1")
def success_criteria(spark, d):
    rows = _doc_facts(spark, d).groupBy("doc").agg(F.count_distinct("rank").alias("n"), *[F.bool_or(F.col("rank") == r).alias(f"r{r}") for r in (5, 12, 13)])
    found = rows.select("doc", tabletop.success_criteria(F.col("n"), F.col("r13"), F.col("r12"), F.when(F.col("r5"), F.array(F.lit("CVE-2024-0001"))).otherwise(F.array())).alias("c"))
    return found.select("doc", F.size("c").alias("criteria"), F.get("c", F.lit(0)).alias("first"))


_ALL = "array_to_string(CASE WHEN len(c) = 0 THEN ['{0}'] ELSE c[1:4] END, '; ')".format(tabletop.BASELINE_CONTROL)
_CASES = ", ".join(f"CASE WHEN bool_or(f IN ({', '.join(repr(x) for x in t)})) THEN '{c}' END" for t, c in tabletop.HEADLINE_RULES)


@query("sim03_nine_rules", f"SELECT doc, {_ALL} AS controls FROM (SELECT doc, list_filter([{_CASES}], lambda x: x IS NOT NULL) AS c FROM (SELECT incident_id AS doc, split_part(technique, '.', 1) AS f FROM facts) GROUP BY 1)")
def nine_rules(spark, d):
    sets = _doc_facts(spark, d).groupBy("doc").agg(F.collect_set("technique").alias("t"))
    return sets.select("doc", F.array_join(tabletop.headline_controls(F.col("t")), "; ").alias("controls"))


_FIRST = "SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY rank) AS place, rank, string_agg(technique, ',' ORDER BY technique) AS techniques, min(technique) AS technique FROM (SELECT DISTINCT incident_id AS doc, rank, technique FROM facts QUALIFY dense_rank() OVER (PARTITION BY doc, rank ORDER BY technique) <= 2) GROUP BY 1, 3"


@query("sim01_expected_detections", f"WITH i AS ({_FIRST}) SELECT doc, place, techniques, CASE WHEN p_size IS NULL THEN 'No rule known' ELSE 'signal ' || p_size END AS signal, coalesce(p_brand, 'unknown') AS source, CASE WHEN rank % 3 = 0 THEN 'first ' || rank || '; second ' || rank ELSE 'Decide the next action and its owner' END AS actions FROM i LEFT JOIN (SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey < 60 AND p_partkey % 2 = 0) ON technique = 'T' || (1000 + p_partkey)")
def expected_detections(spark, d):
    known = table(spark, d, "part").where("p_partkey < 60 and p_partkey % 2 = 0")
    known = known.select(F.concat(F.lit("T"), (F.col("p_partkey") + 1000).cast("string")).alias("technique"), F.concat(F.lit("signal "), F.col("p_size").cast("string")).alias("signal"), F.col("p_brand").alias("source"))
    name = lambda n: F.concat(F.lit(f"{n} "), F.col("id").cast("string"))
    responses = spark.range(0, 14, 3).select(F.col("id").alias("rank"), F.explode(F.array(F.struct(F.lit(2).alias("position"), name("second").alias("action")), F.struct(F.lit(1).alias("position"), name("first").alias("action")))).alias("r")).select("rank", "r.*")
    rows = tabletop.expected(tabletop.injects(_doc_facts(spark, d), _prompts(spark)), known, responses)
    return rows.select("doc", "place", "techniques", "signal", "source", "actions")


_ENTRY = f"{_MATCHES}, v AS (SELECT incident_id, initial_vector FROM incidents), e AS (SELECT m.query, m.incident_id FROM m JOIN v a ON a.incident_id = m.incident_id JOIN v b ON b.incident_id = m.query AND b.initial_vector = a.initial_vector AND b.initial_vector <> 'unknown' QUALIFY row_number() OVER (PARTITION BY m.query ORDER BY m.similarity DESC, m.incident_id) <= 3)"


@query("rnk17_entry_details", f"WITH {_ENTRY}, c AS (SELECT incident_id, string_agg('stage ' || rank, ' > ' ORDER BY rank) AS chain FROM (SELECT DISTINCT incident_id, rank FROM facts) GROUP BY 1), t AS (SELECT incident_id, string_agg(technique, ', ' ORDER BY technique) AS techniques FROM (SELECT DISTINCT incident_id, technique FROM facts QUALIFY dense_rank() OVER (PARTITION BY incident_id ORDER BY technique) <= 6) GROUP BY 1), w AS (SELECT incident_id, string_agg(trim(action), '; ' ORDER BY n) AS worked FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY coalesce(effectiveness, 0) DESC, position, trim(action)) AS n FROM actions QUALIFY n <= 3) GROUP BY 1) SELECT query, incident_id, coalesce(chain, '') AS chain, coalesce(techniques, '') AS techniques, coalesce(worked, '') AS worked FROM e LEFT JOIN c USING (incident_id) LEFT JOIN t USING (incident_id) LEFT JOIN w USING (incident_id)")
def entry_details(spark, d):
    vectors = table(spark, d, "incidents").select("incident_id", "initial_vector")
    found = act.same_entry(vectors.withColumnRenamed("incident_id", "query"), _matches(spark, d).drop("place").join(vectors, "incident_id")).select("query", "incident_id")
    facts = table(spark, d, "facts").withColumn("tactic", F.concat(F.lit("stage "), F.col("rank").cast("string")))
    return act.entry_details(found, facts, table(spark, d, "actions").withColumn("action", F.trim("action")))
