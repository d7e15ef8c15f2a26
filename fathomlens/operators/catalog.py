"""Catalogue access and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import names, privacy

#: What leaves the store: neither raw text nor the contributor's pseudonym.
WITHHELD = ("raw_text", "contributor_ref")


def public_view(incidents: DataFrame) -> DataFrame:
    """All columns but the withheld ones."""
    return incidents.drop(*WITHHELD)


def page(incidents: DataFrame, attack_type: str | None = None, severity: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a filtered list, newest first (ties by id), with the total number of matches on every row."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset 0 or more")
    for column, value in (("attack_type", attack_type), ("severity", severity)):
        if value is not None:
            incidents = incidents.where(F.col(column) == value)
    rows = incidents.orderBy(F.desc("created_at"), "incident_id").offset(offset).limit(limit)
    return rows.join(incidents.agg(F.count("*").alias("total")))  # one row


def fetch(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """The incidents of the given ids; stale ids drop out."""
    return ids.join(incidents, "incident_id")


def upsert(versions: DataFrame, key: str, version: list[Column]) -> DataFrame:
    """The newest version of every key."""
    order = Window.partitionBy(key).orderBy(*[v.desc() for v in version])
    return versions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str = "incident_id") -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the given keys."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def append_children(children: DataFrame, new: DataFrame, key: str = "incident_id", order: str = "ordinal") -> DataFrame:
    """`new` rows with the positions that follow the present ones of their parent, from 0."""
    taken = children.groupBy(key).agg(F.count("*").alias("_taken"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return new.join(taken, key, "left").withColumn("position", (number + F.coalesce("_taken", F.lit(0))).cast("long")).drop("_taken")


def duplicates(shared: DataFrame, new: DataFrame, columns: list[str], nullable: str) -> DataFrame:
    """Rows of `new` that an equal shared row exists for; a null in `nullable` equals a null."""
    same = [shared[c] == new[c] for c in columns] + [shared[nullable].eqNullSafe(new[nullable])]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return new.join(shared, condition, "left_semi")


def same_contributor(stored: Column, viewer: Column) -> Column:
    """Both known and equal."""
    return F.coalesce(stored == viewer, F.lit(False))


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an old and a new schema in one; missing columns are null."""
    return old.unionByName(new, allowMissingColumns=True)


def reindexable(incidents: DataFrame) -> DataFrame:
    """What a rebuilt memory holds: incidents with text to embed."""
    return incidents.where(F.coalesce("embedding_text", F.lit("")) != "").select("incident_id", "embedding_text")


def shareable_actions(actions: DataFrame, texts: tuple[str, ...] = ("action", "notes"), lexicon: DataFrame | None = None, staged=None) -> DataFrame:
    """Actions as they may be shared: their free texts trimmed and sanitised, those without an action left out.

    With a lexicon (see `names`), names without a shape go too; each different text is looked at once, and `staged` (see sources.sinks), which writes what is read twice, is needed."""
    if lexicon is not None and staged is None:
        raise ValueError("names are taken out with staged tables")
    shared = actions.where(F.trim("action") != "")
    for column in (c for c in texts if c in actions.columns):
        shared = shared.withColumn(column, F.trim(column))
        if lexicon is None:
            shared = privacy.redact(shared, column).drop("entities").drop(column).withColumnRenamed("sanitized", column)
            continue
        different = staged(shared.select(F.sha2(column, 256).alias("_key"), F.col(column).alias("_text")).where("_text is not null").distinct())
        safe = names.sanitize(different, lexicon, "_key", "_text", staged).select("_key", "sanitized")
        shared = shared.withColumn("_key", F.sha2(column, 256)).join(safe, "_key", "left").withColumn(column, F.col("sanitized")).drop("_key", "sanitized")
    return shared.select(actions.columns)
