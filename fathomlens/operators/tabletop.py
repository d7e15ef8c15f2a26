"""Tabletop exercises and answers from the memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import family
from .memory import FLOORS


def injects(facts: DataFrame, prompts: DataFrame, per_tactic: int = 2) -> DataFrame:
    """One inject for each observed tactic in order: (doc, place, rank, techniques, prompt).

    facts (doc, rank, technique), prompts (rank, prompt); a tactic without a prompt gets the default one."""
    rows = facts.select("doc", "rank", "technique").distinct()
    number = F.row_number().over(Window.partitionBy("doc", "rank").orderBy("technique"))
    few = rows.withColumn("_n", number).where(F.col("_n") <= per_tactic).groupBy("doc", "rank").agg(F.array_join(F.array_sort(F.collect_list("technique")), ",").alias("techniques"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("rank")).cast("long").alias("place")
    return few.join(prompts, "rank", "left").select("doc", place, "rank", "techniques", F.coalesce("prompt", F.lit("What do you know, and whom do you tell?")).alias("prompt"))


def headline(facts: DataFrame, entry_rank: int) -> DataFrame:
    """(doc, technique): the first technique of the entry tactic, else the first of all, by (rank, technique)."""
    first = F.min_by("technique", F.struct(F.when(F.col("rank") == entry_rank, 0).otherwise(1), "rank", "technique"))
    return facts.groupBy("doc").agg(first.alias("technique"))


def controls(techniques: Column, rules: list[tuple[list[str], str]], most: int = 4, default: str = "Review logging and access") -> Column:
    """Controls whose trigger techniques were seen, in the order of the rules; the default if none was."""
    found = F.filter(F.array(*[F.when(F.arrays_overlap(techniques, F.array(*map(F.lit, t))), F.lit(c)) for t, c in rules]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.array(F.lit(default)))


# Which techniques call for which headline control, in this order.
HEADLINE_RULES = [
    (["T1566", "T1078", "T1110", "T1621"], "Phishing-resistant MFA"),
    (["T1566", "T1204"], "URL filtering and attachment detonation"),
    (["T1078", "T1621", "T1110"], "Identity monitoring and conditional access"),
    (["T1486", "T1490", "T1485"], "Immutable offline backups with rehearsed restore"),
    (["T1059", "T1027", "T1218"], "Script-block logging and application control"),
    (["T1021", "T1550"], "Network segmentation and privileged access workstations"),
    (["T1041", "T1567", "T1048"], "Egress filtering and DLP on outbound transfers"),
    (["T1562", "T1070"], "EDR tamper protection and off-host log forwarding"),
    (["T1190", "T1133"], "Patch SLAs for internet-facing services and WAF coverage"),
]
BASELINE_CONTROL = "Baseline logging, MFA and network segmentation"


def headline_controls(techniques: Column) -> Column:
    """At most four controls of HEADLINE_RULES that the techniques or their families call for, else BASELINE_CONTROL."""
    return controls(F.array_distinct(F.concat(techniques, F.transform(techniques, family))), HEADLINE_RULES, default=BASELINE_CONTROL)


def expected(injects: DataFrame, detections: DataFrame, responses: DataFrame, signal: str = "No rule known", source: str = "unknown", action: str = "Decide the next action and its owner") -> DataFrame:
    """`injects` with the detection of each one's first technique (detections: technique, signal, source) and the response actions of its tactic (responses: rank, position, action), or the
    defaults."""
    first = injects.withColumn("technique", F.substring_index("techniques", ",", 1))
    listed = responses.groupBy("rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "action"))), lambda x: x["action"]), "; ").alias("actions"))
    rows = first.join(detections.groupBy("technique").agg(F.min_by(F.struct("signal", "source"), F.struct("signal", "source")).alias("d")), "technique", "left").join(listed, "rank", "left")
    return rows.select(*injects.columns, F.coalesce("d.signal", F.lit(signal)).alias("signal"), F.coalesce("d.source", F.lit(source)).alias("source"), F.coalesce("actions", F.lit(action)).alias("actions"))


def duration(n_injects: Column) -> Column:
    """Minutes: 30 and 10 for each inject, 120 at most."""
    return F.least(30 + 10 * n_injects, F.lit(120)).cast("long")


def answers(questions: DataFrame, hits: DataFrame, titles: DataFrame, backend: str = "sparse") -> DataFrame:
    """(query, sources, answer): a digest of the relevant hits, or an honest refusal.

    questions (query), hits (query, doc, score, place), titles (doc, title)."""
    good = hits.where(F.col("score") >= FLOORS[backend]).join(titles, "doc")
    line = F.concat(F.lit("- "), "title")
    digest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n")
    told = good.groupBy("query").agg(F.count("*").alias("sources"), digest.alias("digest"))
    refusal = F.lit("The memory holds nothing on this.")
    return questions.join(told, "query", "left").select("query", F.coalesce("sources", F.lit(0)).cast("long").alias("sources"), F.coalesce("digest", refusal).alias("answer"))


def check_citations(claimed: Column, retrieved: Column) -> tuple[Column, Column]:
    """(verified, unsupported) citations."""
    return F.array_intersect(claimed, retrieved), F.array_except(claimed, retrieved)


def context(incidents: DataFrame, facts: DataFrame, actions: DataFrame, most: int = 8) -> DataFrame:
    """(incident_id, context): each incident as compact text for a reader, with its first `most` techniques and actions.

    incidents (incident_id, occurred_at as text, attack_type, initial_vector, severity), facts (incident_id, technique), actions (incident_id, position,
    category, action, effectiveness)."""
    first = lambda rows, *order: rows.withColumn("_n", F.row_number().over(Window.partitionBy("incident_id").orderBy(*order))).where(F.col("_n") <= most)
    named = first(facts.select("incident_id", "technique").distinct(), "technique").groupBy("incident_id").agg(F.array_join(F.sort_array(F.collect_list("technique")), ", ").alias("_techniques"))
    effect = F.when(F.col("effectiveness").isNull(), "").otherwise(F.concat(F.lit(" (effectiveness "), F.round(F.col("effectiveness") * 100).cast("long").cast("string"), F.lit("%)")))
    line = F.concat(F.lit("    - ["), "category", F.lit("] "), "action", effect)
    done = first(actions, "position", "action", "category", "effectiveness").groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("_n", line.alias("l")))).alias("_a"))
    done = done.select("incident_id", F.array_join(F.transform("_a", lambda x: x["l"]), "\n").alias("_done"))
    rows = incidents.join(named, "incident_id", "left").join(done, "incident_id", "left")
    value = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    lines = [
        F.concat(F.lit("INCIDENT "), F.col("incident_id").cast("string")),
        F.concat(F.lit("  Date: "), value("occurred_at", "undated")),
        F.concat(F.lit("  Type: "), value("attack_type", "unknown"), F.lit(" | Entry vector: "), value("initial_vector", "unknown"), F.lit(" | Severity: "), value("severity", "unknown")),
        F.concat(F.lit("  Techniques: "), value("_techniques", "none recorded")),
        F.lit("  Response actions taken:"),
        value("_done", "    - none recorded"),
    ]
    return rows.select("incident_id", F.concat_ws("\n", *lines).alias("context"))


def success_criteria(n_injects: Column, encrypted: Column, exfiltrated: Column, exploited: Column) -> Column:
    """What an exercise must show: three criteria always, more for encrypted data, exfiltrated data and exploited CVEs (an array)."""
    always = [
        F.concat(F.lit("Each of the "), n_injects.cast("string"), F.lit(" phases is detected by a rule, or the gap is logged.")),
        F.lit("Containment of the first affected asset is decided within the target time."),
        F.lit("The way to a decision-maker is walked from end to end, out of hours too."),
    ]
    fix = F.concat(F.lit("The fix for "), F.array_join(exploited, ", "), F.lit(" is applied, or the risk is formally accepted."))
    more = [F.when(encrypted, "A restore from backup is shown within the declared time."), F.when(exfiltrated, "Notification deadlines and their owner are named."), F.when(F.size(exploited) > 0, fix)]
    return F.array_compact(F.array(*always, *more))
