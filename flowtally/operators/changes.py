"""Change between periods, for the same sites in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .line import Line, free_name

#: Fixed value: how sites without a large step are named in results.
STEADY = "No large shift"


def adjacent(panel: DataFrame, value: str = "mean_volume") -> DataFrame:
    """(site, year_month, previous_month, change) for sites in both of two months in a row, with a positive base."""
    now = panel.select("site", "year_month", F.col(value).alias("now"), S.shift_month(F.col("year_month"), -1).alias("previous_month"))
    then = panel.select("site", F.col("year_month").alias("previous_month"), F.col(value).alias("then")).where("then > 0")
    return now.join(then, ["site", "previous_month"]).select("site", "year_month", "previous_month", (F.col("now") / F.col("then") - 1).alias("change"))


def summarized(changes: DataFrame) -> DataFrame:
    c = "change"
    return changes.groupBy("year_month", "previous_month").agg(F.count("*").alias("paired_sites"), F.median(c).alias("median_change"), F.avg(c).alias("mean_change"), F.percentile(c, F.lit(0.25)).alias("p25_change"), F.percentile(c, F.lit(0.75)).alias("p75_change"))


def fixed(panel: DataFrame, earlier: str, later: str, value: str = "mean_volume") -> DataFrame:
    """(site, earlier, later, change) of two months, in one pass; only sites with both."""
    pick = lambda m, n: F.max(F.when(F.col("year_month") == m, F.col(value))).alias(n)
    both = panel.where(F.col("year_month").isin(earlier, later)).groupBy("site").agg(pick(earlier, "earlier"), pick(later, "later"))
    return both.where("earlier IS NOT NULL AND later IS NOT NULL").withColumn("change", S.ratio(F.col("later"), F.col("earlier")))


def consecutive(panel: DataFrame, value: str = "mean_volume") -> DataFrame:
    """panel with the change from the site's row before, if that is the month before; gaps are not bridged."""
    w = Window.partitionBy("site").orderBy("year_month")
    return panel.withColumn("__m", F.lag("year_month").over(w)).withColumn("__v", F.lag(value).over(w)).withColumn("change", F.when((F.col("__m") == S.shift_month(F.col("year_month"), -1)) & (F.col("__v") > 0), F.col(value) / F.col("__v") - 1)).drop("__m", "__v")


def regimes(changes: DataFrame, limit: float = 0.5) -> DataFrame:
    """(site, max_abs_change, flag): Review where a month-to-month change reaches the limit."""
    g = changes.groupBy("site").agg(F.max(F.abs("change")).alias("max_abs_change"))
    return g.withColumn("regime", F.when(F.col("max_abs_change") >= limit, "Review").otherwise(STEADY))


def volatility(panel: DataFrame, value: str = "mean_volume") -> DataFrame:
    g = panel.groupBy("site").agg(F.count("*").alias("months"), F.avg(value).alias("site_mean"), F.stddev_samp(value).alias("site_std"))
    return g.withColumn("cv", F.col("site_std") / F.when(F.col("site_mean") != 0, F.col("site_mean")))


def periods(panel: DataFrame, pre: tuple[str, str], post: tuple[str, str], value: str = "mean_volume") -> DataFrame:
    """Medians and month counts before and after, over ranges of months that include both ends."""
    a, b = F.when(F.col("year_month").between(*pre), F.col(value)), F.when(F.col("year_month").between(*post), F.col(value))
    return panel.groupBy("site").agg(F.median(a).alias("pre_median"), F.count(a).alias("pre_months"), F.median(b).alias("post_median"), F.count(b).alias("post_months"))


def ranked(df: DataFrame, value: str, name: str, key: str = "site") -> DataFrame:
    """Rank from the largest, ties sharing the best place; a null value has no rank. Rows that share a value are told apart by key
    while they are dealt out, so that many of them don't meet in one task: a rank is the number of the first of them."""
    line = Line(df, [F.col(value).desc_nulls_last(), F.col(key)])
    n, was = F.col(line.n), free_name(line.rows, "was")
    line.rows = line.with_near(1, 0, {was: lambda w: F.first(value).over(w)})
    first = F.when((n == 1) | ~F.col(was).eqNullSafe(F.col(value)), n)
    return line.with_last({name: first}).withColumn(name, F.when(F.col(value).isNotNull(), F.col(name).cast("int"))).drop(line.n, was)


def extremes(df: DataFrame, value: str, key: str, low: int, high: int) -> DataFrame:
    """The `low` smallest and `high` largest rows, each once, with `direction`; ties go by key."""
    a = df.where(F.col(value).isNotNull()).orderBy(value, key).limit(low).withColumn("direction", F.lit("Low"))
    b = df.where(F.col(value).isNotNull()).orderBy(F.desc(value), key).limit(high).withColumn("direction", F.lit("High"))
    return a.unionByName(b.join(a.select(key), key, "left_anti"))
