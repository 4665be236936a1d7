"""Hits as a stream (an extension: there is no streaming in what this library re-expresses)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_rates(hits: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sum and number of hits by surface point and time window. ``hits``: ts, active_pid, weight; later ones than ``late`` are dropped.

    Works on a stream and on a table alike.
    """
    h = hits.withWatermark("ts", late) if hits.isStreaming else hits
    g = h.groupBy(F.window("ts", window).alias("w"), "active_pid").agg(F.sum("weight").alias("rate"), F.count("*").alias("n_hits"))
    return g.select(F.col("w.start").alias("start"), "active_pid", "rate", "n_hits")
