"""Tumbling windows over a stream of samples: late rows are dropped beyond the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_mean(samples: DataFrame, width: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """``samples``: ts (timestamp), channel, value; works on streams and on batches alike."""
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "channel")
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "channel", "n", "mean")
