"""Incremental co-occurrence counts of event streams (an extension: counts are mergeable sums)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_counts(events: DataFrame, time: str = "ts", context: str = "user_id", feature: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, cell, feature, n): counts of tumbling windows; later events than the watermark allows are dropped.

    Works on batches and streams alike.
    """
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col(context).cast("string").alias("cell"), F.col(feature).alias("feature")).agg(F.count("*").alias("n"))


def window_pairs(counts: DataFrame, least: int = 1) -> DataFrame:
    """(window, gi, gj, k_ij) of finished windows, from the written counts."""
    present = counts.where(F.col("n") >= least).select("window", "cell", "feature")
    a, b = present.withColumnRenamed("feature", "gi"), present.withColumnRenamed("feature", "gj")
    return a.join(b, ["window", "cell"]).where("gi < gj").groupBy("window", "gi", "gj").agg(F.count("*").alias("k_ij"))


def run_counts(events: DataFrame, out: str, checkpoint: str, **kw) -> None:
    """Drain a stream of events into parquet counts of finished windows."""
    query = feature_counts(events, **kw).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
