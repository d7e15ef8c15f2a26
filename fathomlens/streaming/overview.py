"""Extensions: the overview over a stream of incidents. Sanitising and fingerprinting are stateless and run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, ts: str, label: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, label, n): counts by tumbling window; rows later than the watermark are dropped, state goes with it."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counts = timed.groupBy(F.window("_ts", window).alias("w"), F.coalesce(label, F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "label", "n")


def first_seen(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each shared incident once, however often it is sent within the watermark."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")
