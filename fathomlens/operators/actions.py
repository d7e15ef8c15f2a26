"""What worked before: roll-ups, coverage, gap filling and next stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import family
from .overview import PHASES

UNRATED = 0.6
REUSE_BONUS = 0.15


def roll_up(matches: DataFrame, actions: DataFrame, limit: int = 12) -> DataFrame:
    """Actions of similar incidents, best first, for each query.

    matches (query, incident_id, similarity, place), actions (incident_id, position, action, category, effectiveness).
    An action is known by its trimmed lower-cased text. Its score is the sum of similarity times effectiveness
    (UNRATED where unrated), raised by REUSE_BONUS for every further mention; the mean is over rated mentions. The first
    spelling and category by (place, position) are shown. Ties by key. After the join the rows move once, to their query."""
    rows = matches.join(actions, "incident_id").select("query", "incident_id", "similarity", "place", "position", F.trim("action").alias("action"), "category", "effectiveness").where("action <> ''")
    rows = rows.repartition("query").withColumn("key", F.lower("action"))
    first = F.struct("place", "position")
    sums = rows.groupBy("query", "key").agg(
        F.sum(F.col("similarity") * F.coalesce("effectiveness", F.lit(UNRATED))).alias("weight"),
        F.count("*").alias("times_used"),
        F.round(F.avg("effectiveness"), 4).alias("mean"),
        F.count_distinct("incident_id").alias("sources"),
        F.min_by("action", first).alias("action"),
        F.min_by("category", first).alias("category"),
    )
    scored = sums.withColumn("score", F.round(F.col("weight") * (1 + REUSE_BONUS * (F.col("times_used") - 1)), 4))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).drop("weight")


def coverage(observed: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Controls by the number of observed techniques that they cover, for each query.

    observed (query, technique), edges (control, technique). A sub-technique without a control of its own is covered by
    its parent's. Most first, ties by control. Which controls a technique has is settled once for each different technique, of which there are a catalogue's; a query's
    techniques are brought together once, and counted within its row, so no row of technique with control is made."""
    listed = edges.groupBy("technique").agg(F.array_sort(F.collect_set("control")).alias("controls"))
    each = observed.select("technique").distinct().withColumn("parent", family(F.col("technique")))
    inherited = listed.select(F.col("technique").alias("parent"), F.col("controls").alias("parents"))
    known = each.join(listed, "technique", "left").join(inherited, "parent", "left").select("technique", F.coalesce("controls", "parents").alias("controls")).where("controls is not null")
    # one row: the different sets of controls; a technique names its own by place
    sets = F.broadcast(known.agg(F.array_sort(F.collect_set("controls")).alias("sets")))
    named = known.join(sets).select("technique", (F.array_position("sets", F.col("controls")) - 1).cast("int").alias("set"))
    seen = observed.join(F.broadcast(named), "technique").groupBy("query").agg(F.array_sort(F.collect_set(F.struct("technique", "set"))).alias("t")).join(sets)
    own = lambda x: F.get("sets", x["set"])
    covered = lambda c: F.transform(F.filter("t", lambda x: F.array_contains(own(x), c)), lambda x: x["technique"])
    counted = F.transform(F.array_distinct(F.flatten(F.transform("t", own))), lambda c: F.struct(c.alias("control"), covered(c).alias("t")))
    ranked = F.slice(F.array_sort(F.transform(counted, lambda x: F.struct((-F.size(x["t"])).alias("n"), x["control"].alias("control"), x["t"].alias("t")))), 1, limit)
    rows = seen.select("query", F.posexplode(ranked).alias("i", "c"))
    return rows.select("query", "c.control", (-F.col("c.n")).cast("long").alias("covers"), F.array_join("c.t", ",").alias("techniques"), (F.col("i") + 1).cast("long").alias("place"))


def gap_fill(observed: DataFrame, baseline: DataFrame, recalled: DataFrame) -> DataFrame:
    """Baseline actions (technique, action) for observed techniques that no recalled action (query, action) names already.

    A technique with its own entry doesn't take its parent's. An action is suggested once for each query, for the first technique by id. What a technique suggests is
    settled once for each different one, of which there are a catalogue's; techniques and recalled actions are brought together by query, and stay there."""
    each = observed.select("technique").distinct()
    bare = each.join(baseline.select("technique").distinct(), "technique", "left_anti").withColumn("parent", family(F.col("technique"))).where("parent <> technique")
    inherited = bare.join(baseline.withColumnRenamed("technique", "parent"), "parent").select("technique", "action")
    known = each.join(baseline, "technique").select("technique", "action").union(inherited).distinct()
    seen = observed.groupBy("query").agg(F.collect_set("technique").alias("t"))
    done = recalled.groupBy("query").agg(F.collect_set(F.lower(F.trim("action"))).alias("done"))
    rows = seen.join(done, "query", "left").select("query", "done", F.explode("t").alias("technique")).join(F.broadcast(known), "technique").withColumn("key", F.lower("action"))
    new = rows.where(F.col("done").isNull() | ~F.array_contains("done", F.col("key")))
    return new.groupBy("query", "key").agg(F.min("technique").alias("for_technique"), F.min_by("action", F.struct("technique", "action")).alias("action")).drop("key")


def by_phase(actions: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """(…, phase_no): the number of the action's phase in the fixed order; unknown ones are dropped, or kept last as 99."""
    number = F.coalesce(*[F.when(F.col("category") == p, F.lit(i)) for i, p in enumerate(PHASES, 1)], F.lit(99)).cast("long")
    rows = actions.withColumn("phase_no", number)
    return rows if keep_unknown else rows.where("phase_no < 99")


def what_worked(actions: DataFrame, limit: int = 5) -> DataFrame:
    """Of (query, action, score, recalled): the recalled ones if the query has any, else the suggested; best first, ties by action."""
    any_recalled = F.max(F.col("recalled").cast("int")).over(Window.partitionBy("query"))
    rows = actions.withColumn("_any", any_recalled).where((F.col("_any") == 0) | F.col("recalled")).drop("_any")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "action")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def same_entry(query: DataFrame, matches: DataFrame, limit: int = 3) -> DataFrame:
    """Matches (query, incident_id, initial_vector, similarity) with the query's own known vector (query, initial_vector)."""
    known = query.where("initial_vector is not null and initial_vector <> 'unknown'")
    rows = matches.join(known, ["query", "initial_vector"])
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "incident_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def entry_details(matches: DataFrame, facts: DataFrame, actions: DataFrame, names: int = 6, best: int = 3) -> DataFrame:
    """`matches` (…, incident_id) with chain, the incident's tactics in order, techniques, its first `names` by id, and worked, its `best` most effective actions (ties by position).

    facts (incident_id, rank, tactic, technique), actions (incident_id, position, action, effectiveness). Each incident is looked up once, however many queries match it."""
    needed = matches.select("incident_id").distinct()
    own = facts.join(needed, "incident_id", "left_semi")
    chain = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "tactic"))), lambda x: x["tactic"]), " > ").alias("chain")
    told = own.groupBy("incident_id").agg(chain, F.array_join(F.slice(F.array_sort(F.collect_set("technique")), 1, names), ", ").alias("techniques"))
    order = Window.partitionBy("incident_id").orderBy(F.desc(F.coalesce("effectiveness", F.lit(0.0))), "position", "action")
    few = actions.join(needed, "incident_id", "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= best)
    worked = few.groupBy("incident_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "action"))), lambda x: x["action"]), "; ").alias("worked"))
    rows = matches.join(told, "incident_id", "left").join(worked, "incident_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("chain", "techniques", "worked")})


def next_steps(reached: DataFrame, stages: DataFrame, limit: int = 4) -> DataFrame:
    """Stages that similar incidents reached after the query's furthest one.

    reached (query, rank), stages (query, incident_id, rank, stage). An incident counts once for a stage. The
    `limit` most frequent (ties: earlier stage) are numbered in stage order."""
    far = reached.groupBy("query").agg(F.max("rank").alias("far"))
    later = stages.join(far, "query").where("rank > far")
    counts = later.groupBy("query", "rank", "stage").agg(F.count_distinct("incident_id").alias("n"))
    often = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "rank"))
    chosen = counts.withColumn("_often", often).where(F.col("_often") <= limit).drop("_often")
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank")).cast("long"))


def examples(rows: DataFrame, keys: list[str], label: str, ordinal: list[str], k: int = 3) -> DataFrame:
    """Up to k distinct labels of a key in the order of their first ordinal, as one comma-joined text."""
    first = rows.groupBy(*keys, label).agg(F.min(F.struct(*ordinal)).alias("_first"))
    numbered = first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", label))).where(F.col("_n") <= k)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", label))), lambda x: x[label]), ",")
    return numbered.groupBy(*keys).agg(listed.alias("examples"))
