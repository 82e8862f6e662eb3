"""Daily site volumes over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(stream: DataFrame, lateness: str = "1 day", width: str = "15 minutes") -> DataFrame:
    """(start, site, observations, volume) of tumbling windows; what comes later than `lateness` is left out.

    stream: (ts timestamp, site, value). State is kept per open window and site, and dropped behind the watermark.
    """
    g = stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "site").agg(F.count("value").alias("observations"), F.sum("value").alias("volume"))
    return g.select(F.col("window.start").alias("start"), "site", "observations", "volume")
