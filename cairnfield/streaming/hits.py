"""Streams of access-log hits: counts by window, and sessions (`trials` joins them with trials, `ledger` appends them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.operators.experiment import artifact_of


def hourly(hits: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Hits (ts as a timestamp) by window and kind of document; rows later than the watermark are dropped."""
    kinds = hits.withColumn("artifact", F.coalesce(artifact_of(F.col("path")), F.lit("other")))
    return kinds.withWatermark("ts", late).groupBy(F.window("ts", width), "artifact").agg(F.count("*").alias("n"))


def sessions(hits: DataFrame, *, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Hits of a host and agent with pauses of at most `gap`."""
    return hits.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "host", "ua").agg(F.count("*").alias("n"))
