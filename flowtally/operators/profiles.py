"""Site profiles over time: one grouped pass each, partial sums first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def monthly(fact: DataFrame, value: str = "value", coverage: str = "coverage", per_day: int = 96) -> DataFrame:
    """(year_month, site) volumes, and coverage over rows with a value; fact: (site, ts, value, coverage)."""
    v = F.col(value)
    g = fact.withColumn("year_month", S.month(F.col("ts"))).groupBy("year_month", "site").agg(
        F.count("*").alias("source_observations"), F.count(v).alias("valid_observations"), F.avg(v).alias("mean_volume"), F.median(v).alias("median_volume"),
        F.sum(v).alias("total_volume"), F.avg(F.when(v.isNotNull(), F.col(coverage))).alias("detector_coverage"), F.max(F.to_date("ts")).alias("__d"),
    )
    g = g.withColumn("expected_observations", S.expected_intervals(F.col("__d"), per_day))
    return g.withColumn("temporal_coverage", F.col("valid_observations") / F.col("expected_observations")).drop("__d")


def daily(fact: DataFrame, value: str = "value", per_day: int = 96) -> DataFrame:
    """(date, site) volumes; a day without any value has no row."""
    d = fact.where(F.col(value).isNotNull()).groupBy(F.to_date("ts").alias("date"), "site")
    return d.agg(F.count("*").alias("valid_observations"), F.sum(value).alias("total_volume"), F.avg(value).alias("mean_volume"), (F.count("*") / per_day).alias("temporal_coverage"))


def hour_of_week(fact: DataFrame, value: str = "value") -> DataFrame:
    """(site, weekday, hour) sums and means; weekday 0 is Monday, bin = 24 * weekday + hour."""
    d = fact.where(F.col(value).isNotNull()).groupBy("site", F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour"))
    return d.agg(F.sum(value).alias("volume_sum"), F.count("*").alias("observations")).withColumn("mean_volume", F.col("volume_sum") / F.col("observations")).withColumn("bin", F.col("weekday") * 24 + F.col("hour"))


def heatmap(hours: DataFrame) -> DataFrame:
    """Weekday by hour matrix h00..h23 over all sites; weekdays without data are rows of nulls."""
    week = hours.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    cells = hours.groupBy("weekday", "hour").agg((F.sum("volume_sum") / F.sum("observations")).alias("m"))
    wide = cells.groupBy("weekday").agg(*[F.max(F.when(F.col("hour") == h, F.col("m"))).alias(f"h{h:02d}") for h in range(24)])
    return week.join(wide, "weekday", "left")


def approaches(sides: DataFrame) -> DataFrame:
    """(year_month, site, approach) means and coverages; sides: (site, ts, approach, volume, coverage)."""
    return sides.groupBy(S.month(F.col("ts")).alias("year_month"), "site", "approach").agg(F.avg("volume").alias("mean_volume"), F.count("volume").alias("observations"), F.avg("coverage").alias("coverage"))


def approach_shares(monthly_sides: DataFrame, names: list[str], minimum: float = 0.8, top: int = 12) -> DataFrame:
    """The `top` sites by volume with each side's share of it; a site that lacks a usable side has none."""
    ok = monthly_sides.where((F.col("coverage") >= minimum) & F.col("mean_volume").isNotNull() & (F.col("observations") > 0))
    each = [(F.sum(F.when(F.col("approach") == n, F.col("mean_volume") * F.col("observations"))) / F.sum(F.when(F.col("approach") == n, F.col("observations")))).alias(f"{n}_mean") for n in names]
    total = sum((F.col(f"{n}_mean") for n in names[1:]), F.col(f"{names[0]}_mean"))
    g = ok.groupBy("site").agg(*each).withColumn("total", total).where("total IS NOT NULL")
    return g.select("site", "total", *[(F.col(f"{n}_mean") / F.col("total")).alias(f"{n}_share") for n in names]).orderBy(F.desc("total"), "site").limit(top)
