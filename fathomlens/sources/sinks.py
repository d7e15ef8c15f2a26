"""Writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is configured, a temporary one is set on one machine, and it is an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """`df`, computed once and read again from a table in the shared folder, for what several branches of a plan need."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_incidents(incidents: DataFrame, actions: DataFrame, root: str) -> None:
    """Append incidents, then their actions, to two Parquet tables. The search memory is derived from them, so it is never written beside them."""
    incidents.write.mode("append").partitionBy("provenance").parquet(f"{root}/incidents")
    actions.write.mode("append").parquet(f"{root}/actions")


def markdown(title: Column, fields: dict[str, Column]) -> Column:
    """A report of one heading and a table of fields; nulls read unknown."""
    lines = [F.concat(F.lit("# Incident "), title.cast("string")), F.lit(""), F.lit("| Field | Value |"), F.lit("| --- | --- |")]
    lines += [F.concat(F.lit(f"| {name} | "), F.coalesce(value.cast("string"), F.lit("unknown")), F.lit(" |")) for name, value in fields.items()]
    return F.array_join(F.array(*lines), "\n")
