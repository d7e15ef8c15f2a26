"""Resemblance of observed technique sets to published profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def specificity(profiles: DataFrame) -> DataFrame:
    """(technique, weight) with weight = ln((N + 1) / (df + 1)) + 1 over profiles (profile, technique)."""
    total = profiles.select("profile").distinct().count()
    return profiles.distinct().groupBy("technique").agg(F.count("*").alias("df")).select("technique", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("weight"))


def resemblance(observed: DataFrame, profiles: DataFrame, k: int = 3, least_shared: int = 2, least: float = 0.30) -> DataFrame:
    """(query, profile, shared, coverage, band, place): profiles that cover enough of the observed weight.

    coverage is the weight of shared techniques over that of all observed (unpublished ones weigh 1). Bands: notable
    from .75, moderate from .50, else weak. Best coverage first, then most shared, ties by profile.

    Techniques are ordered from the rarest. A profile with enough coverage shares one of a query's prefix, behind which too little weight is left, and a second technique after
    it; so the two rarest shared ones are the key of the join, and common techniques alone bring no candidates. Each pair is met under that key only, so none has to be
    removed twice. Profiles of equal techniques are met once, so the work follows the different ones."""
    if least_shared < 2:
        raise ValueError("two techniques at least make a resemblance")
    weights = specificity(profiles)
    item = lambda weight: F.struct((-weight).alias("o"), F.col("technique").alias("t"))
    published = profiles.distinct().join(weights, "technique").groupBy("profile").agg(F.array_sort(F.collect_list(item(F.col("weight")))).alias("theirs"))
    seen = observed.distinct().join(weights, "technique", "left")
    known = F.array_sort(F.collect_list(F.when(F.col("weight").isNotNull(), item(F.col("weight")))))
    asked = seen.groupBy("query").agg(known.alias("own"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("whole"))

    key = lambda a, b: F.struct(a["t"].alias("a"), b["t"].alias("b"))
    pairs = lambda items, first: F.flatten(F.transform(items, lambda x, i: F.when(first(i), F.transform(F.slice(items, i + 2, F.size(items)), lambda y: key(x, y))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))))
    behind = lambda i: F.aggregate(F.slice("own", i + 1, F.size("own")), F.lit(0.0), lambda s, x: s - x["o"])
    asked = asked.select("query", "own", "whole", F.explode(pairs(F.col("own"), lambda i: behind(i) >= (least - 1e-4) * F.col("whole"))).alias("key"))
    # profiles of the same techniques are one class, of which the k smallest ids can be among a query's best
    classes = published.withColumn("_n", F.row_number().over(Window.partitionBy("theirs").orderBy("profile"))).where(F.col("_n") <= k).groupBy("theirs").agg(F.sort_array(F.collect_list("profile")).alias("profiles"))
    published = classes.select("profiles", "theirs", F.explode(pairs(F.col("theirs"), lambda i: F.lit(True))).alias("key"))
    both = asked.join(published, "key").withColumn("both", F.array_intersect("own", "theirs")).where(key(F.get("both", F.lit(0)), F.get("both", F.lit(1))) == F.col("key"))
    part = F.aggregate("both", F.lit(0.0), lambda s, x: s - x["o"])
    rows = both.select("query", "profiles", F.size("both").cast("long").alias("shared"), F.round(part / F.col("whole"), 4).alias("coverage")).where((F.col("shared") >= least_shared) & (F.col("coverage") >= least))
    # a query's best classes bring their profiles: k classes are enough, ties by their smallest
    best = Window.partitionBy("query").orderBy(F.desc("coverage"), F.desc("shared"), F.get("profiles", F.lit(0)))
    rows = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("query", F.explode("profiles").alias("profile"), "shared", "coverage")
    band = F.when(F.col("coverage") >= 0.75, "notable").when(F.col("coverage") >= 0.5, "moderate").otherwise("weak")
    order = Window.partitionBy("query").orderBy(F.desc("coverage"), F.desc("shared"), "profile")
    return rows.select("query", "profile", "shared", "coverage", band.alias("band"), F.row_number().over(order).cast("long").alias("place")).where(F.col("place") <= k)


def campaigns_of(matched: DataFrame, campaigns: DataFrame, k: int = 5) -> DataFrame:
    """The first k campaigns (campaign, group, ordinal) of any matched group (semi-join), by ordinal, then campaign and group."""
    rows = campaigns.join(matched.select("group").distinct(), "group", "left_semi")
    return rows.orderBy("ordinal", "campaign", "group").limit(k)
