"""Trusted and common panels, and city series over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trusted(monthly: DataFrame, temporal: float, detector: float = 0.0) -> DataFrame:
    """Site-months whose coverages reach both thresholds; an unknown coverage is not trusted."""
    return monthly.where((F.col("temporal_coverage") >= temporal) & (F.col("detector_coverage") >= detector))


def city_monthly(panel: DataFrame) -> DataFrame:
    v = "mean_volume"
    return panel.groupBy("year_month").agg(F.median(v).alias("median_volume"), F.avg(v).alias("city_mean"), F.percentile(v, F.lit(0.25)).alias("p25"), F.percentile(v, F.lit(0.75)).alias("p75"), F.count_distinct("site").alias("sites"))


def common(panel: DataFrame, year: int) -> DataFrame:
    """Rows of the year, of sites that are in the panel in all its twelve months."""
    y = panel.where(F.col("year_month").startswith(f"{year}-"))
    full = y.groupBy("site").agg(F.count_distinct("year_month").alias("k")).where("k = 12").select("site")
    return y.join(full, "site", "left_semi")


def month_of_year(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.substring("year_month", 6, 2).cast("int").alias("month")).agg(F.avg("mean_volume").alias("month_mean"), F.median("mean_volume").alias("month_median"), F.stddev_samp("mean_volume").alias("month_std"), F.count("*").alias("site_months"))


def month_by_year(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.substring("year_month", 1, 4).cast("int").alias("year"), F.substring("year_month", 6, 2).cast("int").alias("month")).agg(F.median("mean_volume").alias("median_volume"), F.count_distinct("site").alias("sites"))


def site_baseline(panel: DataFrame, year: int, candidates: int = 18, base: int = 8, top: int = 12) -> DataFrame:
    """Index (100 = the site's median of `year`) of the `top` sites by mean among those with enough months."""
    inside = F.when(F.col("year_month").startswith(f"{year}-"), F.col("mean_volume"))
    s = panel.groupBy("site").agg(F.avg("mean_volume").alias("site_mean"), F.count("*").alias("months"), F.median(inside).alias("baseline"), F.count(inside).alias("base_months"))
    chosen = s.where((F.col("months") >= candidates) & (F.col("base_months") >= base)).orderBy(F.desc("site_mean"), "site").limit(top)
    return panel.join(F.broadcast(chosen), "site").select("site", "year_month", (100 * F.col("mean_volume") / F.when(F.col("baseline") != 0, F.col("baseline"))).alias("index"))
