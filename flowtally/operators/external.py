"""Daily context from outside: weather, policy, holidays and events on one spine; its joins with counts, months, checks.

Every table here has one row per day or month, so its windows without a partition stay small whatever the counts' size;
site days are only joined to them, by a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import context, quality

# Columns of the policy series, and what they are called in the daily table.
POLICY = {
    "C1M_School closing": "covid_school_closing_level",
    "C1M_Flag": "covid_school_closing_general_flag",
    "C2M_Workplace closing": "covid_workplace_closing_level",
    "C2M_Flag": "covid_workplace_closing_general_flag",
    "C3M_Cancel public events": "covid_public_event_cancel_level",
    "C3M_Flag": "covid_public_event_cancel_general_flag",
    "C4M_Restrictions on gatherings": "covid_gathering_restriction_level",
    "C4M_Flag": "covid_gathering_restriction_general_flag",
    "C5M_Close public transport": "covid_public_transport_closing_level",
    "C5M_Flag": "covid_public_transport_closing_general_flag",
    "C6M_Stay at home requirements": "covid_stay_home_level",
    "C6M_Flag": "covid_stay_home_general_flag",
    "C7M_Restrictions on internal movement": "covid_internal_movement_restriction_level",
    "C7M_Flag": "covid_internal_movement_restriction_general_flag",
    "C8EV_International travel controls": "covid_international_travel_control_level",
    "H6M_Facial Coverings": "covid_facial_covering_level",
    "StringencyIndex_Average": "covid_stringency_index",
    "GovernmentResponseIndex_Average": "covid_government_response_index",
    "ContainmentHealthIndex_Average": "covid_containment_health_index",
    "EconomicSupportIndex": "covid_economic_support_index",
    "ConfirmedCases": "covid_confirmed_cases_cumulative",
    "ConfirmedDeaths": "covid_confirmed_deaths_cumulative",
}
CUMULATIVE = {"covid_confirmed_cases_cumulative": "covid_new_cases_derived", "covid_confirmed_deaths_cumulative": "covid_new_deaths_derived"}
MOBILITY = ("covid_workplace_closing_level", "covid_public_transport_closing_level", "covid_stay_home_level", "covid_internal_movement_restriction_level")
# What the calendar's and the events' columns are called in the daily table, and its factors.
NAMES = {
    "holiday": "is_official_holiday", "is_friday": "is_friday_weekend", "is_nowruz": "is_nowruz_window", "is_nowruz_official": "is_nowruz_official_days", "in_window": "is_ramadan_approx",
    "days_to_holiday": "days_to_nearest_official_holiday", "day_before_holiday": "is_day_before_holiday", "day_after_holiday": "is_day_after_holiday", "is_nonworking": "is_nonworking_day",
    "event_count": "manual_event_count", "event_types": "manual_event_types", "event_names": "manual_event_names", "max_confidence": "manual_event_confidence_rank",
}
FACTORS = {
    "official_holiday": "is_official_holiday", "friday_weekend": "is_friday_weekend", "nowruz_window": "is_nowruz_window", "ramadan_approx": "is_ramadan_approx", "wet_weather": "is_wet_day",
    "heavy_precipitation": "is_heavy_precipitation_day", "hot_day_35c": "is_hot_day", "freezing_day": "is_freezing_day", "covid_mobility_restriction": "covid_any_mobility_restriction", "documented_manual_event": "manual_event_count",
}
HIJRI_MONTHS = ("Farvardin", "Ordibehesht", "Khordad", "Tir", "Mordad", "Shahrivar", "Mehr", "Aban", "Azar", "Dey", "Bahman", "Esfand")
CORE_WEATHER = ("temperature_mean_c", "relative_humidity_mean_pct", "precipitation_sum_mm", "cloud_cover_mean_pct", "wind_speed_mean_kmh")


def calendar(days: DataFrame, holidays: DataFrame, windows=()) -> DataFrame:
    """context.calendar() under the daily table's names, with the holidays' names ('' on other days). holidays: (date, name_en, name_fa)."""
    names = holidays.groupBy("date").agg(*[F.array_join(F.array_sort(F.collect_set(f"name_{k}")), "; ").alias(f"official_holiday_name_{k}") for k in ("en", "fa")])
    d = context.calendar(days, holidays, windows).join(F.broadcast(names), "date", "left").na.fill("", ["official_holiday_name_en", "official_holiday_name_fa"])
    d = d.withColumn("jalali_date", F.format_string("%04d-%02d-%02d", "jalali_year", "jalali_month", "jalali_day"))
    return d.withColumn("jalali_month_name_en", F.element_at(F.array(*[F.lit(m) for m in HIJRI_MONTHS]), F.col("jalali_month"))).withColumnsRenamed(NAMES)


def weather_days(hours: DataFrame) -> DataFrame:
    """Hourly to daily weather in one aggregation. Sums are null where nothing is known, and flags 0."""
    t, p, v = F.col("temperature_2m"), F.col("precipitation"), F.col("wind_speed_10m")
    g = hours.groupBy(F.to_date("ts").alias("date")).agg(
        F.count("*").alias("weather_hour_count"), F.avg(t).alias("temperature_mean_c"), F.min(t).alias("temperature_min_c"), F.max(t).alias("temperature_max_c"),
        F.avg("relative_humidity_2m").alias("relative_humidity_mean_pct"), F.sum(p).alias("precipitation_sum_mm"), F.sum("rain").alias("rain_sum_mm"), F.sum("snowfall").alias("snowfall_sum_cm"),
        F.avg("cloud_cover").alias("cloud_cover_mean_pct"), F.avg(v).alias("wind_speed_mean_kmh"), F.max(v).alias("wind_speed_max_kmh"), F.max("wind_gusts_10m").alias("wind_gust_max_kmh"), F.count_if(p >= 0.1).alias("wet_hours"),
    )
    rain, high, low = F.col("precipitation_sum_mm"), F.col("temperature_max_c"), F.col("temperature_min_c")
    return g.withColumns({"is_heavy_precipitation_day": S.flag(rain >= 10), "is_wet_day": S.flag(rain >= 0.1), "is_hot_day": S.flag(high >= 35), "is_freezing_day": S.flag(low <= 0)})


def policy_days(days: DataFrame, series: DataFrame) -> DataFrame:
    """days (date) with the series (date and POLICY's values): availability, new cases and deaths, any restriction of movement.

    Before the series begins levels and totals are 0; gaps inside leave levels null and keep the last totals.
    """
    series = series.withColumn("__in", F.lit(1))
    by = Window.orderBy("date")
    begins = series.agg(F.min("date")).first()[0]
    early = F.lit(False) if begins is None else F.col("date") < F.lit(begins)
    d = days.select("date").join(F.broadcast(series), "date", "left").withColumn("covid_data_available", F.coalesce("__in", F.lit(0))).drop("__in")
    d = d.withColumns({c: F.coalesce(F.when(early, F.coalesce(F.col(c), F.lit(0.0))), F.col(c)) for c in POLICY.values()})
    d = d.withColumns({c: F.last(c, True).over(by.rowsBetween(Window.unboundedPreceding, 0)) for c in CUMULATIVE})
    d = d.withColumns({new: F.coalesce(F.col(c) - F.lag(c).over(by), F.lit(0.0)) for c, new in CUMULATIVE.items()})
    return d.withColumn("covid_any_mobility_restriction", S.flag(F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in MOBILITY]) > 0))


def event_days(days: DataFrame, events: DataFrame) -> DataFrame:
    """context.event_days() over the registry's confidence words (low, medium, high: 1 to 3, others 0)."""
    word = F.lower("source_confidence")
    ranked = events.withColumn("confidence", F.when(word == "low", 1).when(word == "medium", 2).when(word == "high", 3).otherwise(0))
    return context.event_days(days.select("date"), ranked).drop("has_event").na.fill(0, ["max_confidence"]).withColumnsRenamed(NAMES)


def daily(dates: DataFrame, *parts: DataFrame) -> DataFrame:
    """dates ⟕ each part, one to one: a part with a date twice raises."""
    return reduce(lambda d, p: d.join(F.broadcast(quality.require_unique(p, "date")), "date", "left"), parts, dates)


def site_context(site_days: DataFrame, days: DataFrame) -> DataFrame:
    """Site days with their day's context, many to one."""
    return site_days.join(F.broadcast(quality.require_unique(days, "date")), "date", "left")


def city_context(site_days: DataFrame, days: DataFrame, temporal: float = 0.8) -> DataFrame:
    """days with the counts of the sites whose day is covered (detector coverage isn't asked for), and whether there are any."""
    g = site_days.where(F.col("temporal_coverage") >= temporal).groupBy("date").agg(
        F.count_distinct("site").alias("trusted_intersection_count"), F.median("mean_volume").alias("city_median_15min_volume"), F.avg("mean_volume").alias("city_mean_15min_volume"), F.sum("total_volume").alias("city_total_volume_estimate")
    )
    return days.join(g, "date", "left").withColumn("traffic_data_available", F.col("city_median_15min_volume").isNotNull().cast("int"))


def associations(city_days: DataFrame) -> DataFrame:
    """For each factor: days with it and without it, and their volumes raw, against the median of the month and weekday
    (adjusted) and of the month. An unknown factor counts as absent. One pass over the days; they are no proof of causes."""
    v = "city_median_15min_volume"
    d = context.adjusted(city_days.where(F.col(v).isNotNull()), v).withColumns({"a": 100 * (1 + F.col("vs_month_weekday")), "m": 100 * (1 + F.col("vs_month"))})
    stack = f"stack({len(FACTORS)}, " + ", ".join(f"'{k}', coalesce({c}, 0) > 0" for k, c in FACTORS.items()) + ") AS (context_factor, yes)"
    s = d.selectExpr("a", "m", f"{v} AS v", stack)
    on, off = (lambda c: F.when(F.col("yes"), F.col(c))), (lambda c: F.when(~F.col("yes"), F.col(c)))
    g = s.groupBy("context_factor").agg(
        F.count_if("yes").alias("flagged_days_with_traffic"), F.count_if(~F.col("yes")).alias("comparison_days_with_traffic"), F.avg(on("a")).alias("flagged_mean_adjusted_volume_index"),
        F.median(on("a")).alias("flagged_median_adjusted_volume_index"), F.avg(off("a")).alias("comparison_mean_adjusted_volume_index"), F.avg(on("m")).alias("flagged_mean_month_adjusted_volume_index"),
        F.avg(off("m")).alias("comparison_mean_month_adjusted_volume_index"), F.avg(on("v")).alias("flagged_mean_raw_15min_volume"), F.avg(off("v")).alias("comparison_mean_raw_15min_volume"),
    )
    less = lambda k: F.col(f"flagged_mean_{k}adjusted_volume_index") - F.col(f"comparison_mean_{k}adjusted_volume_index")
    return g.withColumns({"adjusted_index_difference_points": less(""), "month_adjusted_index_difference_points": less("month_")})


def months(days: DataFrame) -> DataFrame:
    """Monthly context; sums of nothing known are 0, means null."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return days.groupBy(S.month(F.col("date")).alias("year_month")).agg(
        F.count("*").alias("calendar_days"), total("is_official_holiday", "official_holiday_days"), total("is_friday_weekend", "friday_days"), total("is_nowruz_window", "nowruz_window_days"), total("is_ramadan_approx", "ramadan_approx_days"),
        F.count_if(F.col("manual_event_count") > 0).alias("manual_event_days"), F.avg("temperature_mean_c").alias("temperature_mean_c"), F.max("temperature_max_c").alias("temperature_max_c"), total("precipitation_sum_mm", "precipitation_sum_mm"),
        total("is_heavy_precipitation_day", "heavy_precipitation_days"), F.avg("covid_stringency_index").alias("covid_stringency_mean"), F.max("covid_stringency_index").alias("covid_stringency_max"), total("covid_any_mobility_restriction", "covid_mobility_restriction_days"),
    )


def checks(days: DataFrame, expected: DataFrame, series: DataFrame) -> DataFrame:
    """One row: rows and dates against the expected spine, days without weather (each field and any), days without policy
    from the start of its series on, and whether all is well."""
    begins = series.agg(F.min("date")).first()[0]
    inside = F.lit(False) if begins is None else F.col("date") >= F.lit(begins)
    gone = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in CORE_WEATHER])
    d = days.agg(
        F.count("*").alias("daily_rows"), (F.count("*") - F.count_distinct("date")).alias("duplicate_dates"), F.count_if(gone).alias("weather_missing_days"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in CORE_WEATHER],
        F.count_if(inside & (F.col("covid_data_available") == 0)).alias("covid_missing_days_inside_source_window"), F.coalesce(F.sum("is_official_holiday"), F.lit(0)).alias("official_holiday_days"), F.count_if(F.col("manual_event_count") > 0).alias("manual_event_days"),
    )
    n = expected.count()
    ok = (F.col("daily_rows") == n) & (F.col("duplicate_dates") == 0) & (F.col("weather_missing_days") == 0) & (F.col("covid_missing_days_inside_source_window") == 0)
    return d.withColumn("expected_daily_rows", F.lit(n)).withColumn("passed", ok)
