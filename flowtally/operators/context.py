"""Calendar, events, daily context and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .line import Line, free_name


def spine(spark: SparkSession, start: str, end: str, step: str = "DAY") -> DataFrame:
    """One row per day, or per first of a month, with both ends."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', INTERVAL 1 {step})")).alias("date"))


def calendar(days: DataFrame, holidays: DataFrame, windows: list[tuple[str, str]] = ()) -> DataFrame:
    """days (date) with weekday parts, Solar Hijri date, flags, and days to the nearest holiday (either way).

    holidays: (date). The nearest is the last one carried forwards or the next one carried backwards along the days; null if
    there is none. The days before and after are the next rows.
    """
    d = days.join(F.broadcast(holidays.select("date").distinct().withColumn("h", F.lit(1))), "date", "left").withColumn("holiday", F.coalesce("h", F.lit(0))).drop("h")
    line = Line(d, [F.col("date")])
    n, last, coming = F.col(line.n), free_name(line.rows, "last"), free_name(line.rows, "coming")
    line.rows = line.with_last({last: F.when(F.col("holiday") == 1, F.col("date"))})
    line.rows = line.with_last({coming: F.when(F.col("holiday") == 1, F.col("date"))}, back=True)
    d = line.with_near(1, 1, {"day_before_holiday": lambda w: F.when(n < line.total, F.last("holiday").over(w)).otherwise(0), "day_after_holiday": lambda w: F.when(n > 1, F.first("holiday").over(w)).otherwise(0)})
    j = S.jalali(F.col("date"))
    friday, thursday = F.weekday("date") == 4, F.weekday("date") == 3
    inside: Column = F.lit(False)
    for a, b in windows:
        inside = inside | F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return d.withColumns({
        "weekday": F.weekday("date"), "weekday_name": F.date_format("date", "EEEE"), "is_friday": S.flag(friday), "is_thursday": S.flag(thursday),
        "jalali_year": j["year"], "jalali_month": j["month"], "jalali_day": j["day"], "is_nowruz": S.flag((j["month"] == 1) & (j["day"] <= 13)), "is_nowruz_official": S.flag((j["month"] == 1) & (j["day"] <= 4)),
        "in_window": S.flag(inside), "days_to_holiday": F.least(F.datediff("date", last), F.datediff(coming, F.col("date"))), "is_nonworking": S.flag(friday | (F.col("holiday") == 1)),
    }).drop(line.n, last, coming)


def event_days(days: DataFrame, events: DataFrame) -> DataFrame:
    """Per day: number of events that run on it, their sorted distinct types and names, the highest confidence rank."""
    each = events.select("event_type", "event_name", "confidence", F.explode(F.sequence("date_start", "date_end")).alias("date"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    g = each.groupBy("date").agg(F.count("*").alias("event_count"), joined("event_type").alias("event_types"), joined("event_name").alias("event_names"), F.max("confidence").alias("max_confidence"))
    d = days.join(g, "date", "left")
    return d.withColumns({"event_count": F.coalesce("event_count", F.lit(0)), "event_types": F.coalesce("event_types", F.lit("")), "event_names": F.coalesce("event_names", F.lit("")), "has_event": S.flag(F.col("event_count") > 0)})


def filled(days: DataFrame, cumulative: DataFrame, value: str) -> DataFrame:
    """days ⟕ a cumulative series: availability, the last known value, and its first difference (null is 0)."""
    d = days.join(cumulative.select("date", value).withColumn("available", F.lit(1)), "date", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    line = Line(d, [F.col("date")])
    line.rows = line.with_last({value: F.col(value)})
    was = free_name(line.rows, "was")
    d = line.with_near(1, 0, {was: lambda w: F.when(F.count("*").over(w) == 2, F.first(value).over(w))})
    return d.withColumn(f"new_{value}", F.coalesce(F.col(value) - F.col(was), F.lit(0))).drop(line.n, was)


def daily_index(city: DataFrame, value: str, year: int) -> DataFrame:
    """city (date, value) with the index against the year's median of the same month and weekday, and its median over 7
    rows where at least 4 have one."""
    c = city.withColumn("m", F.month("date")).withColumn("w", F.weekday("date"))
    base = c.where(F.year("date") == year).groupBy("m", "w").agg(F.median(value).alias("baseline"))
    d = c.join(F.broadcast(base), ["m", "w"], "left").withColumn("day_index", 100 * F.col(value) / F.when(F.col("baseline") != 0, F.col("baseline")))
    line = Line(d.drop("m", "w"), [F.col("date")])
    return line.with_near(6, 0, {"rolling_index": lambda w: F.when(F.count("day_index").over(w) >= 4, F.expr("percentile(day_index, 0.5)").over(w))}).drop(line.n)


def adjusted(city: DataFrame, value: str) -> DataFrame:
    """city with percent deviations from its month-and-weekday and its month median."""
    ym = S.month(F.col("date"))
    a, b = F.median(value).over(Window.partitionBy(ym, F.weekday("date"))), F.median(value).over(Window.partitionBy(ym))
    return city.withColumns({"vs_month_weekday": F.col(value) / F.when(a != 0, a) - 1, "vs_month": F.col(value) / F.when(b != 0, b) - 1})


def associations(days: DataFrame, factors: list[str], value: str) -> DataFrame:
    """For each 0/1 factor: days with and without it, means, medians and their differences, in one pass."""
    stack = f"stack({len(factors)}, " + ", ".join(f"'{f}', CAST({f} AS INT)" for f in factors) + ") AS (factor, on)"
    s = days.selectExpr(value, stack)
    yes, no = F.when(F.col("on") == 1, F.col(value)), F.when(F.col("on") == 0, F.col(value))
    g = s.groupBy("factor").agg(F.count(yes).alias("flagged_days"), F.count(no).alias("other_days"), F.avg(yes).alias("flagged_mean"), F.avg(no).alias("other_mean"), F.median(yes).alias("flagged_median"), F.median(no).alias("other_median"))
    return g.withColumn("mean_difference", F.col("flagged_mean") - F.col("other_mean")).withColumn("median_difference", F.col("flagged_median") - F.col("other_median"))


def weather_days(hours: DataFrame, value: str = "value") -> DataFrame:
    """Hourly to daily: counts, extremes, sums (null if nothing is known), hours over 0.1, and threshold flags."""
    v = F.col(value)
    g = hours.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("hours"), F.avg(v).alias("mean_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v).alias("sum_value"), F.count_if(v >= 0.1).alias("wet_hours"))
    return g.withColumns({"is_heavy": S.flag(F.col("sum_value") >= 10), "is_hot": S.flag(F.col("max_value") >= 35), "is_freezing": S.flag(F.col("min_value") <= 0)})


def months(days: DataFrame) -> DataFrame:
    """Monthly context of weather_days()."""
    return days.groupBy(S.month(F.col("date")).alias("year_month")).agg(F.count("*").alias("days"), F.coalesce(F.sum("sum_value"), F.lit(0.0)).alias("total"), F.avg("mean_value").alias("mean_of_means"), F.max("max_value").alias("highest"), F.sum("is_heavy").alias("heavy_days"), F.sum("is_hot").alias("hot_days"))
