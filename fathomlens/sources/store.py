"""A store of incidents and their actions whose versions appear whole or not at all, with the search memory kept in step.

Every change is a batch of tables in folders of its own; a manifest of one row, written last, is the commit. What a failed write leaves behind is in no
manifest, so readers see the version before it. The memory is term counts by batch and changes of document frequencies, so adding and deleting
need no rebuild. Ids are met by sorted joins: their columns compress so well that Spark would take millions of them for small and broadcast them through the driver. One writer at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from .corpora import optional

_MANIFEST = "version long, batches array<string>, deleted array<string>, documents long"


class Store:
    """Tables under `root`: incidents (incident_id, embedding_text, …) and actions (incident_id, …)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def manifest(self, version: int | None = None) -> tuple[int, list[str], list[str], int]:
        """(version, batches, batches of deleted ids, documents) of a version, by default the newest; version 0 is empty."""
        rows = optional(self.spark, f"{self.root}/manifests/*", _MANIFEST)
        rows = rows if version is None else rows.where(F.col("version") == version)
        found = rows.orderBy(F.desc("version")).limit(1).collect()
        return (found[0].version, list(found[0].batches), list(found[0].deleted), found[0].documents) if found else (0, [], [], 0)

    def _read(self, name: str, batches: list[str]) -> DataFrame | None:
        if not batches:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{name}/{b}") for b in batches]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def table(self, name: str, version: int | None = None, key: str = "incident_id") -> DataFrame | None:
        """The rows of a table (incidents, actions, terms) in a version, without those of deleted incidents; None where nothing was ever added."""
        _, batches, deleted, _ = self.manifest(version)
        rows, gone = self._read(name, batches), self._read("deleted", deleted)
        if rows is None or gone is None:
            return rows
        # an id may be added again after it was deleted: a deletion names the batches before it
        gone = gone.select(F.col("incident_id").alias("_id"), F.explode("from").alias("_batch")).hint("merge")
        return rows.join(gone, (F.col(key) == F.col("_id")) & (F.col("batch") == F.col("_batch")), "left_anti")

    def frequencies(self, version: int | None = None) -> DataFrame | None:
        """(term, df) of the memory: the sum of all changes."""
        _, batches, deleted, _ = self.manifest(version)
        changes = [x for x in (self._read("changes", batches), self._read("changes", deleted)) if x is not None]
        if not changes:
            return None
        every = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
        return every.groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")

    def _commit(self, version: int, batches: list[str], deleted: list[str], documents: int) -> int:
        row = self.spark.createDataFrame([(version + 1, batches, deleted, documents)], _MANIFEST)
        row.coalesce(1).write.json(f"{self.root}/manifests/{version + 1:012d}-{uuid.uuid4().hex}")
        return version + 1

    def add(self, incidents: DataFrame, actions: DataFrame) -> int:
        """Add incidents with their actions; the new version's number.

        Ids must be there, once, and not in the store; actions must belong to the new incidents. Otherwise it is a ValueError and nothing changes."""
        version, batches, deleted, documents = self.manifest()
        batch = uuid.uuid4().hex
        incidents.withColumn("batch", F.lit(batch)).write.parquet(f"{self.root}/incidents/{batch}")
        rows = self.spark.read.parquet(f"{self.root}/incidents/{batch}")  # checked as written, so a source that changes can't slip through
        n, ids = rows.count(), rows.select("incident_id").where("incident_id is not null").distinct()
        if ids.count() != n:
            raise ValueError("an incident has no id, or one that another has too")
        known = self.table("incidents")
        if known is not None and not ids.join(known.select("incident_id").hint("merge"), "incident_id", "left_semi").isEmpty():
            raise ValueError("an incident is in the store already")
        actions.withColumn("batch", F.lit(batch)).write.parquet(f"{self.root}/actions/{batch}")
        if not self.spark.read.parquet(f"{self.root}/actions/{batch}").join(ids.hint("merge"), "incident_id", "left_anti").isEmpty():
            raise ValueError("an action belongs to no new incident")
        text = rows.where(F.coalesce("embedding_text", F.lit("")) != "")
        terms = memory.term_counts(text, "incident_id", "embedding_text").withColumn("batch", F.lit(batch))
        terms.write.parquet(f"{self.root}/terms/{batch}")
        counts = self.spark.read.parquet(f"{self.root}/terms/{batch}").groupBy("term").agg(F.count("*").alias("change"))
        counts.write.parquet(f"{self.root}/changes/{batch}")
        return self._commit(version, [*batches, batch], deleted, documents + text.count())

    def delete(self, ids: DataFrame) -> int:
        """Delete incidents (incident_id), their actions and what the memory knows of them; unknown ids are passed over."""
        version, batches, deleted, documents = self.manifest()
        known = self.table("incidents")
        if known is None:
            return version
        batch = uuid.uuid4().hex
        gone = known.join(ids.select("incident_id").distinct().hint("merge"), "incident_id", "left_semi")
        gone.select("incident_id", F.array("batch").alias("from"), (F.coalesce("embedding_text", F.lit("")) != "").alias("told")).write.parquet(f"{self.root}/deleted/{batch}")
        gone = self.spark.read.parquet(f"{self.root}/deleted/{batch}")
        terms = self.table("terms", key="doc").join(gone.select(F.col("incident_id").alias("doc")).hint("merge"), "doc", "left_semi")
        terms.groupBy("term").agg((-F.count("*")).alias("change")).write.parquet(f"{self.root}/changes/{batch}")
        return self._commit(version, batches, [*deleted, batch], documents - gone.where("told").count())

    def search(self, queries: DataFrame, query: str, text: str, k: int, staged) -> DataFrame:
        """The k best incidents of each query (query, doc, score, place), from the memory as it stands; no rows from an empty one."""
        counts, total = self.table("terms", key="doc"), F.lit(self.manifest()[3])
        if counts is None:
            return self.spark.createDataFrame([], "query long, doc long, score double, place long")
        weights = staged(memory.weighted(self.frequencies(), total))
        vectors = memory.document_vectors(counts.drop("batch"), weights)
        asked = staged(memory.query_vectors(memory.term_counts(queries, query, text), weights, total).withColumnRenamed("w", "q"))
        return memory.pruned_top_k(asked, vectors, k, staged)[0]
