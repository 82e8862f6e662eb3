"""Queries over the report's result sets, the explorer's charts, the daily context and the geocoder, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, detectors, external
from . import datasets
from .catalogue import CHANGES, CITY, EVENTS, FACT, HOURS, LABELS, MONTHLY, PAIRS, SIDES, YEAR, query, report_sets, table

#: Thresholds of a panel in which some sites have all months.
WIDE = 0.1, 0.0
SPINE = """sm AS (SELECT strftime(ts, '%Y-%m') AS year_month, count(DISTINCT ts) AS k FROM fact GROUP BY 1),
sp AS (SELECT unnest(generate_series(DATE '1991-06-01', DATE '1999-06-01', INTERVAL 1 MONTH))::DATE AS date),
st AS (SELECT strftime(date, '%Y-%m') AS year_month, coalesce(k, 0) / day(last_day(date))::DOUBLE AS coverage, CASE WHEN k IS NULL THEN 'Missing' WHEN k < 0.8 * day(last_day(date)) THEN 'Partial' ELSE 'Complete' END AS status FROM sp LEFT JOIN sm ON sm.year_month = strftime(date, '%Y-%m')),
"""
COMMON = MONTHLY + f"""cy AS (SELECT * FROM m WHERE temporal_coverage >= 0.1 AND detector_coverage >= 0 AND year_month LIKE '{YEAR}-%'), ck AS (SELECT site FROM cy GROUP BY 1 HAVING count(DISTINCT year_month) = 12),
se AS (SELECT substr(year_month, 6, 2)::INT AS month, avg(mean_volume) AS month_mean, median(mean_volume) AS month_median, count(*) AS site_months FROM cy WHERE site IN (SELECT site FROM ck) GROUP BY 1),
"""
MONTHS = "(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'])"


def chart(spark: SparkSession, d: str, name: str) -> DataFrame:
    return datasets.explorer(report_sets(spark, d), name)


# --- the explorer's charts -------------------------------------------------------------------------------------------


@query("section x ~y label", PAIRS + SPINE + """g AS (SELECT year_month, previous_month, median(change) AS y FROM q GROUP BY 1, 2),
r AS (SELECT 'city' AS section, st.year_month || '-01' AS x, y, previous_month || ' → ' || g.year_month AS label FROM st LEFT JOIN g USING (year_month))""")
def explorer_changes(spark, d):
    return chart(spark, d, "changes")


@query("section trace x ~y", HOURS + """c AS (SELECT weekday, hour, sum(volume_sum) / sum(observations) AS y FROM h GROUP BY 1, 2),
r AS (SELECT 'patterns' AS section, (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[w + 1] AS trace, k::VARCHAR AS x, y FROM (SELECT unnest(range(7)) AS w) CROSS JOIN (SELECT unnest(range(24)) AS k) LEFT JOIN c ON c.weekday = w AND c.hour = k)""")
def explorer_weekly(spark, d):
    return chart(spark, d, "weekly")


@query("section x ~y label", COMMON + f"r AS (SELECT 'patterns' AS section, {MONTHS}[month] AS x, month_median AS y, (SELECT count(*) FROM ck)::VARCHAR AS label FROM se)")
def explorer_seasonality(spark, d):
    return datasets.explorer(report_sets(spark, d, *WIDE), "seasonality")


@query("section trace ~x ~y label", CHANGES + LABELS + "r AS (SELECT 'sites' AS section, l.site::VARCHAR AS trace, shock_change AS x, recovery_change AS y, label FROM per JOIN l USING (site) WHERE shock_change IS NOT NULL AND recovery_change IS NOT NULL)")
def explorer_shock_recovery(spark, d):
    return chart(spark, d, "shock_recovery").withColumn("x", F.col("x").cast("double"))


@query("section trace ~x ~y label", CHANGES + LABELS + "r AS (SELECT 'sites' AS section, l.site::VARCHAR AS trace, site_mean AS x, weighted_degree AS y, label FROM l LEFT JOIN per USING (site))")
def explorer_groups(spark, d):
    return chart(spark, d, "groups").withColumn("x", F.col("x").cast("double"))


@query("section trace x ~y", SIDES + SPINE + """a1 AS (SELECT year_month, upper(approach[1]) || approach[2:] AS approach, mean_volume FROM a WHERE site = 1), n AS (SELECT DISTINCT approach FROM a1),
ev AS (SELECT st.year_month, status, n.approach, mean_volume FROM st CROSS JOIN n LEFT JOIN a1 ON a1.year_month = st.year_month AND a1.approach = n.approach),
r AS (SELECT 'sites' AS section, approach AS trace, year_month || '-01' AS x, CASE WHEN status = 'Complete' THEN mean_volume END AS y FROM ev UNION ALL SELECT 'sites', approach || ' (partial)', year_month || '-01', mean_volume FROM ev WHERE status = 'Partial')""")
def explorer_approaches(spark, d):
    return chart(spark, d, "approaches")


@query("section trace x ~y", FACT + SPINE + "r AS (SELECT 'quality' AS section, status AS trace, year_month || '-01' AS x, coverage AS y FROM st)")
def explorer_coverage(spark, d):
    return chart(spark, d, "coverage")


# --- result sets -----------------------------------------------------------------------------------------------------


@query("~shock_change_median shock_change_sites ~recovery_change_median recovery_change_sites ~latest_change_median latest_change_sites ~invalid_rate observed_days calendar_days trusted_site_months graph_nodes communities graph_edges mapped_sites ~map_coverage", CHANGES + CITY + """
r AS (SELECT median(shock_change) AS shock_change_median, count(shock_change) AS shock_change_sites, median(recovery_change) AS recovery_change_median, count(recovery_change) AS recovery_change_sites, median(latest_change) AS latest_change_median, count(latest_change) AS latest_change_sites,
  (SELECT count(*) FILTER (value IS NULL) / count(*)::DOUBLE FROM fact) AS invalid_rate, (SELECT count(*) FROM c) AS observed_days, (SELECT count(*) FROM c) AS calendar_days, (SELECT count(*) FROM p) AS trusted_site_months, (SELECT count(*) FROM supplier) AS graph_nodes,
  (SELECT count(DISTINCT s_nationkey) FROM supplier) AS communities, 0::BIGINT AS graph_edges, 0::BIGINT AS mapped_sites, 0.0 AS map_coverage FROM per)""")
def report_headline(spark, d):
    return report_sets(spark, d)["headline"]


@query("site label ~shock_change", CHANGES + LABELS + "r AS (SELECT site, label, shock_change FROM per JOIN l USING (site) WHERE shock_change IS NOT NULL ORDER BY shock_change, site LIMIT 12)")
def report_shock_rank(spark, d):
    return report_sets(spark, d)["shock_rank"]


@query("site label ~latest_change direction", CHANGES + LABELS + """f AS (SELECT site, label, latest_change FROM per JOIN l USING (site) WHERE latest_change IS NOT NULL),
lo AS (SELECT * FROM f ORDER BY latest_change, site LIMIT 8), hi AS (SELECT * FROM f ORDER BY latest_change DESC, site LIMIT 8),
r AS (SELECT *, 'Low' AS direction FROM lo UNION ALL SELECT *, 'High' FROM hi WHERE site NOT IN (SELECT site FROM lo))""")
def report_latest_extremes(spark, d):
    return report_sets(spark, d)["latest_extremes"]


@query("month month_name ~month_mean ~month_median site_months common_panel_sites", COMMON + f"r AS (SELECT *, {MONTHS}[month] AS month_name, (SELECT count(*) FROM ck) AS common_panel_sites FROM se)")
def report_seasonality(spark, d):
    return report_sets(spark, d, *WIDE)["seasonality"]


@query("factor factor_label ~mean_difference", CITY + """x AS (SELECT value, (isodow(date) = 5)::INT AS is_friday, (isodow(date) = 4)::INT AS is_thursday, (day(date) IN (1, 17) AND month(date) % 3 = 0)::INT AS holiday FROM c),
s AS (SELECT 'is_friday' AS factor, 'Is Friday' AS factor_label, value, is_friday AS f FROM x UNION ALL SELECT 'is_thursday', 'Is Thursday', value, is_thursday FROM x UNION ALL SELECT 'holiday', 'Holiday', value, holiday FROM x),
r AS (SELECT factor, factor_label, avg(value) FILTER (f = 1) - avg(value) FILTER (f = 0) AS mean_difference FROM s GROUP BY 1, 2)""")
def report_context_effects(spark, d):
    return report_sets(spark, d)["context_effects"]


@query("year_month previous_month month_date period_label paired_sites ~median_change", PAIRS + "r AS (SELECT year_month, previous_month, year_month || '-01' AS month_date, previous_month || ' → ' || year_month AS period_label, count(*) AS paired_sites, median(change) AS median_change FROM q GROUP BY 1, 2)")
def report_paired_changes(spark, d):
    return report_sets(spark, d)["paired_changes"]


@query("weekday weekday_name ~h00 ~h12 ~h23", HOURS + """c AS (SELECT weekday, hour, sum(volume_sum) / sum(observations) AS y FROM h GROUP BY 1, 2),
r AS (SELECT w::INT AS weekday, (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[w + 1] AS weekday_name, max(y) FILTER (hour = 0) AS h00, max(y) FILTER (hour = 12) AS h12, max(y) FILTER (hour = 23) AS h23 FROM (SELECT unnest(range(7)) AS w) LEFT JOIN c ON c.weekday = w GROUP BY 1, 2)""")
def report_week(spark, d):
    return report_sets(spark, d)["hour_week_heatmap"]


@query("site label community_label ~shock_change ~recovery_change trusted_months", CHANGES + LABELS + "r AS (SELECT site, label, 'Community ' || community AS community_label, shock_change, recovery_change, months AS trusted_months FROM per JOIN l USING (site) WHERE shock_change IS NOT NULL AND recovery_change IS NOT NULL)")
def report_shock_recovery(spark, d):
    return report_sets(spark, d)["shock_recovery"]


# --- places ----------------------------------------------------------------------------------------------------------

BOX = (32.601, 51.601, 32.648, 51.648)


def place_names(spark: SparkSession, d: str) -> DataFrame:
    """(site, name): suppliers as junctions without a name, with that of a square, or of two streets, some in Arabic letters."""
    k = F.col("s_suppkey")
    streets = F.concat(F.lit("st. Alpha"), (k % 30).cast("string"), F.when(k % 4 == 3, " – way بيك").otherwise(" - way Beta"), (k % 20).cast("string"))
    name = F.when(k % 4 == 0, F.when(k % 8 == 0, F.lit(" "))).when(k % 4 == 2, F.concat(F.lit(" Plaza"), (k % 25).cast("string"))).otherwise(streets)
    return table(spark, d, "supplier").select(k.alias("site"), name.alias("name"))


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of squares and streets made of the customers; two in three lie inside the box."""
    k = F.col("c_custkey")
    kind = k % 4
    name = F.when(kind == 0, F.concat(F.lit("Alpha"), (k % 30).cast("string"))).when(kind == 1, F.concat(F.lit("Beta"), (k % 20).cast("string"))).when(kind == 2, F.concat(F.lit("Plaza"), (k % 25).cast("string"))).otherwise(F.concat(F.lit("بیک"), (k % 20).cast("string")))
    rank = F.floor(k / F.when(kind == 0, 60).when(kind == 2, 100).otherwise(20)).cast("int")
    return table(spark, d, "customer").select(F.concat(name, F.lit(", Town")).alias("query"), rank.alias("rank"), (32.6 + (k * 7 % 500) / 10000.0).alias("lat"), (51.6 + (k * 13 % 500) / 10000.0).alias("lon"), F.lit("way").alias("osm_type"), k.cast("string").alias("osm_id"), F.concat(F.lit("place "), k.cast("string")).alias("display_name"))


PLACES = f"""n AS (SELECT s_suppkey AS site, CASE WHEN s_suppkey % 4 = 2 THEN 'Plaza' || (s_suppkey % 25) WHEN s_suppkey % 4 = 1 THEN 'st. Alpha' || (s_suppkey % 30) || ' - way Beta' || (s_suppkey % 20) WHEN s_suppkey % 4 = 3 THEN 'st. Alpha' || (s_suppkey % 30) || ' – way بیک' || (s_suppkey % 20) END AS name,
  'Alpha' || (s_suppkey % 30) AS a, CASE WHEN s_suppkey % 4 = 1 THEN 'Beta' ELSE 'بیک' END || (s_suppkey % 20) AS b FROM supplier),
g AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'Alpha' || (c_custkey % 30) WHEN 1 THEN 'Beta' || (c_custkey % 20) WHEN 2 THEN 'Plaza' || (c_custkey % 25) ELSE 'بیک' || (c_custkey % 20) END || ', Town' AS query,
  c_custkey // (CASE c_custkey % 4 WHEN 0 THEN 60 WHEN 2 THEN 100 ELSE 20 END) AS rank, 32.6 + (c_custkey * 7 % 500) / 10000.0 AS lat, 51.6 + (c_custkey * 13 % 500) / 10000.0 AS lon, c_custkey AS id FROM customer),
k AS (SELECT * FROM g WHERE lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]}),
own AS (SELECT site, arg_min(row(lat, lon, id), rank) AS c FROM n JOIN k ON query = name || ', Town' AND rank <= 5 GROUP BY 1),
j AS (SELECT site, x.lat AS la, x.lon AS oa, y.lat AS lb, y.lon AS ob, x.rank AS ra, y.rank AS rb, x.id AS ia, y.id AS ib, x.query AS qa, y.query AS qb, 2 * 6371000 * asin(sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))) AS m
  FROM n JOIN k x ON x.query = a || ', Town' AND x.rank <= 15 JOIN k y ON y.query = b || ', Town' AND y.rank <= 15 WHERE site % 2 = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY m, ra, rb) AS i FROM j WHERE m <= 1500),
"""


@query("site ~latitude ~longitude geocode_method geocode_confidence geocode_query ~match_distance_m osm_id", PLACES + """
r AS (SELECT n.site, coalesce(c[1], (la + lb) / 2) AS latitude, coalesce(c[2], (oa + ob) / 2) AS longitude, CASE WHEN c IS NOT NULL THEN 'direct_name' WHEN m IS NOT NULL THEN 'street_pair' WHEN name IS NOT NULL THEN 'unmatched' END AS geocode_method,
  CASE WHEN c IS NOT NULL THEN 'medium' WHEN m <= 150 THEN 'high' WHEN m <= 500 THEN 'medium' WHEN m IS NOT NULL THEN 'low' WHEN name IS NOT NULL THEN 'none' END AS geocode_confidence,
  CASE WHEN c IS NOT NULL THEN name || ', Town' WHEN m IS NOT NULL THEN qa || ' | ' || qb ELSE name END AS geocode_query, CASE WHEN c IS NOT NULL THEN 0.0 ELSE m END AS match_distance_m, CASE WHEN c IS NOT NULL THEN c[3]::VARCHAR WHEN m IS NOT NULL THEN ia || '|' || ib END AS osm_id
  FROM n LEFT JOIN own USING (site) LEFT JOIN t ON t.site = n.site AND t.i = 1)""")
def geocoded_sites(spark, d):
    return detectors.geocoded(place_names(spark, d), gazetteer(spark, d), "Town", [r"st\.", "way"], BOX)


@query("site community ~lat ~lon confidence reliable", PLACES + """
z AS (SELECT n.site, coalesce(c[1], (la + lb) / 2) AS lat, coalesce(c[2], (oa + ob) / 2) AS lon, CASE WHEN c IS NOT NULL THEN 'medium' WHEN m <= 150 THEN 'high' WHEN m <= 500 THEN 'medium' WHEN m IS NOT NULL THEN 'low' WHEN name IS NOT NULL THEN 'none' END AS confidence, c IS NOT NULL AS direct
  FROM n LEFT JOIN own USING (site) LEFT JOIN t ON t.site = n.site AND t.i = 1),
r AS (SELECT site, s_nationkey AS community, lat, lon, confidence, coalesce((direct OR confidence = 'high') AND lat IS NOT NULL, false) AS reliable FROM supplier JOIN z ON z.site = s_suppkey)""")
def sites_on_the_map(spark, d):
    place = geocoded(spark, d)
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("community"))
    return datasets.map_sites(nodes, place)


def geocoded(spark: SparkSession, d: str) -> DataFrame:
    found = detectors.geocoded(place_names(spark, d), gazetteer(spark, d), "Town", [r"st\.", "way"], BOX)
    return found.select("site", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("geocode_confidence").alias("confidence"), F.col("geocode_method").alias("method"))


# --- daily context ---------------------------------------------------------------------------------------------------

FIRST, LAST = "2023-12-28", "2024-02-03"


def hours(spark: SparkSession, d: str) -> DataFrame:
    """The events as readings of the weather."""
    v, k = F.col("value"), F.col("user_id")
    given = {"temperature_2m": v / 5 - 5, "relative_humidity_2m": v * 2, "precipitation": (k % 10) / 1000.0, "rain": (k % 10) / 2000.0, "snowfall": (k % 7) / 1000.0, "cloud_cover": (k % 100).cast("double"), "wind_speed_10m": v, "wind_gusts_10m": v * 1.5}
    return table(spark, d, "events").select("ts", *[c.cast("double").alias(n) for n, c in given.items()])


def policy(spark: SparkSession, d: str) -> DataFrame:
    """A series of levels and totals for some days of the month, out of the orders' numbers."""
    g = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 30).alias("k")).agg(F.count("*").alias("n")).where("k % 7 <> 3")
    level = lambda i, c: (F.col("k") * F.col("k") + F.col("n")).cast("double") if c in external.CUMULATIVE else ((F.col("k") + i) % 5 % 3).cast("double")
    return g.select(F.expr("date_add(DATE'2024-01-02', CAST(k AS INT))").alias("date"), *[level(i, c).alias(c) for i, c in enumerate(external.POLICY.values())])


def context_days(spark: SparkSession, d: str) -> DataFrame:
    dates = context.spine(spark, FIRST, LAST)
    n = F.col("n_nationkey")
    free = table(spark, d, "nation").where(n % 6 == 0).select(F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).alias("date"), F.col("n_name").alias("name_en"), F.lower("n_name").alias("name_fa"))
    r = F.col("r_regionkey").cast("int")
    fairs = table(spark, d, "region").select(F.date_add(F.lit("2024-01-03").cast("date"), r * 3).alias("date_start"), F.date_add(F.lit("2024-01-03").cast("date"), r * 4 + 1).alias("date_end"), F.lit("fair").alias("event_type"), F.col("r_name").alias("event_name"), F.when(r % 2 == 0, "High").otherwise("low").alias("source_confidence"))
    return external.daily(external.calendar(dates, free, [("2024-01-20", "2024-01-25")]), external.weather_days(hours(spark, d)), external.policy_days(dates, policy(spark, d)), external.event_days(dates, fairs))


def _levels() -> str:
    names = list(external.POLICY.values())
    return ", ".join(f"{'(k * k + n)' if c in external.CUMULATIVE else f'((k + {i}) % 5 % 3)'}::DOUBLE AS {c}" for i, c in enumerate(names))


CONTEXT = f"""d AS (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY))::DATE AS date),
fr AS (SELECT DATE '2024-01-01' + n_nationkey::INT AS date, n_name FROM nation WHERE n_nationkey % 6 = 0),
hn AS (SELECT date, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS name FROM fr GROUP BY 1),
hd AS (SELECT d.date, (hn.date IS NOT NULL)::INT AS holiday, coalesce(name, '') AS name FROM d LEFT JOIN hn USING (date)),
ca AS (SELECT *, lead(holiday, 1, 0) OVER (ORDER BY date) AS before_holiday, lag(holiday, 1, 0) OVER (ORDER BY date) AS after_holiday, least(date - last_value(CASE WHEN holiday = 1 THEN date END IGNORE NULLS) OVER (ORDER BY date), first_value(CASE WHEN holiday = 1 THEN date END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - date)::INT AS near,
  (isodow(date) = 5)::INT AS friday, (date BETWEEN DATE '2024-01-20' AND DATE '2024-01-25')::INT AS ramadan FROM hd),
we AS (SELECT ts::DATE AS date, count(*) AS weather_hour_count, avg(value / 5 - 5) AS temperature_mean_c, max(value / 5 - 5) AS temperature_max_c, min(value / 5 - 5) AS low, avg(value * 2) AS humidity, sum((user_id % 10) / 1000.0) AS precipitation_sum_mm, avg((user_id % 100)::DOUBLE) AS cloud, avg(value) AS wind, max(value * 1.5) AS wind_gust_max_kmh FROM events GROUP BY 1),
po AS (SELECT DATE '2024-01-02' + k::INT AS date, {_levels()} FROM (SELECT o_orderkey % 30 AS k, count(*) AS n FROM orders GROUP BY 1) WHERE k % 7 <> 3),
pd AS (SELECT d.date, (po.date IS NOT NULL)::INT AS covid_data_available, d.date < (SELECT min(date) FROM po) AS early, po.* EXCLUDE (date) FROM d LEFT JOIN po USING (date)),
pf AS (SELECT date, covid_data_available, CASE WHEN early THEN coalesce(covid_stay_home_level, 0) ELSE covid_stay_home_level END AS covid_stay_home_level, CASE WHEN early THEN 0 ELSE covid_stringency_index END AS covid_stringency_index,
  last_value(CASE WHEN early THEN 0 ELSE covid_confirmed_cases_cumulative END IGNORE NULLS) OVER (ORDER BY date) AS cases, greatest({', '.join(f'coalesce({c}, 0)' for c in external.MOBILITY)}) > 0 AS restricted FROM pd),
pn AS (SELECT *, coalesce(cases - lag(cases) OVER (ORDER BY date), 0) AS covid_new_cases_derived FROM pf),
ev AS (SELECT r_name, r_regionkey % 2 = 0 AS sure, unnest(generate_series(DATE '2024-01-03' + (r_regionkey * 3)::INT, DATE '2024-01-03' + (r_regionkey * 4 + 1)::INT, INTERVAL 1 DAY))::DATE AS date FROM region),
eg AS (SELECT date, count(*) AS k, string_agg(DISTINCT r_name, ' | ' ORDER BY r_name) AS names, max(CASE WHEN sure THEN 3 ELSE 1 END) AS sure FROM ev GROUP BY 1),
o AS (SELECT ca.date, holiday AS is_official_holiday, name AS official_holiday_name_en, before_holiday AS is_day_before_holiday, after_holiday AS is_day_after_holiday, near AS days_to_nearest_official_holiday, friday AS is_friday_weekend, ramadan AS is_ramadan_approx,
  weather_hour_count, temperature_mean_c, temperature_max_c, humidity, cloud, wind, precipitation_sum_mm, wind_gust_max_kmh, CASE WHEN we.date IS NOT NULL THEN coalesce(low <= 0, false)::INT END AS is_freezing_day, CASE WHEN we.date IS NOT NULL THEN coalesce(precipitation_sum_mm >= 0.1, false)::INT END AS is_wet_day, CASE WHEN we.date IS NOT NULL THEN coalesce(precipitation_sum_mm >= 10, false)::INT END AS heavy,
  covid_data_available, covid_stay_home_level, covid_stringency_index, covid_new_cases_derived, restricted::INT AS covid_any_mobility_restriction, coalesce(k, 0) AS manual_event_count, coalesce(names, '') AS manual_event_names, coalesce(sure, 0) AS manual_event_confidence_rank
  FROM ca LEFT JOIN we USING (date) LEFT JOIN pn USING (date) LEFT JOIN eg USING (date)),
"""


@query("date is_official_holiday official_holiday_name_en is_day_before_holiday is_day_after_holiday days_to_nearest_official_holiday is_friday_weekend is_ramadan_approx weather_hour_count ~temperature_mean_c ~temperature_max_c ~precipitation_sum_mm ~wind_gust_max_kmh is_freezing_day is_wet_day covid_data_available ~covid_stay_home_level ~covid_stringency_index ~covid_new_cases_derived covid_any_mobility_restriction manual_event_count manual_event_names manual_event_confidence_rank", CONTEXT + "r AS (SELECT * FROM o)")
def daily_context(spark, d):
    """Calendar, weather, policy and events on one spine of days."""
    return context_days(spark, d)


@query("year_month calendar_days official_holiday_days friday_days ramadan_approx_days manual_event_days ~temperature_mean_c ~precipitation_sum_mm heavy_precipitation_days ~covid_stringency_mean ~covid_stringency_max covid_mobility_restriction_days", CONTEXT + """
r AS (SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS calendar_days, sum(is_official_holiday)::BIGINT AS official_holiday_days, sum(is_friday_weekend)::BIGINT AS friday_days, sum(is_ramadan_approx)::BIGINT AS ramadan_approx_days, count(*) FILTER (manual_event_count > 0) AS manual_event_days, avg(temperature_mean_c) AS temperature_mean_c,
  coalesce(sum(precipitation_sum_mm), 0) AS precipitation_sum_mm, coalesce(sum(heavy), 0)::BIGINT AS heavy_precipitation_days, avg(covid_stringency_index) AS covid_stringency_mean, max(covid_stringency_index) AS covid_stringency_max, sum(covid_any_mobility_restriction)::BIGINT AS covid_mobility_restriction_days FROM o GROUP BY 1)""")
def context_by_month(spark, d):
    return external.months(context_days(spark, d))


@query("daily_rows expected_daily_rows duplicate_dates weather_missing_days covid_missing_days_inside_source_window official_holiday_days manual_event_days passed", CONTEXT + """
q AS (SELECT count(*) AS daily_rows, count(*) AS expected_daily_rows, 0::BIGINT AS duplicate_dates, count(*) FILTER (temperature_mean_c IS NULL OR humidity IS NULL OR cloud IS NULL OR wind IS NULL OR precipitation_sum_mm IS NULL) AS weather_missing_days,
  count(*) FILTER (covid_data_available = 0 AND date >= (SELECT min(date) FROM po)) AS covid_missing_days_inside_source_window, sum(is_official_holiday)::BIGINT AS official_holiday_days, count(*) FILTER (manual_event_count > 0) AS manual_event_days FROM o),
r AS (SELECT *, weather_missing_days = 0 AND covid_missing_days_inside_source_window = 0 AS passed FROM q)""")
def context_quality(spark, d):
    return external.checks(context_days(spark, d), context.spine(spark, FIRST, LAST), policy(spark, d))


@query("site date ~mean_volume is_official_holiday ~temperature_max_c covid_any_mobility_restriction", EVENTS + CONTEXT + """s AS (SELECT site, ts::DATE AS date, avg(value) AS mean_volume FROM e GROUP BY 1, 2),
r AS (SELECT site, s.date, mean_volume, is_official_holiday, temperature_max_c, covid_any_mobility_restriction FROM s LEFT JOIN o USING (date))""")
def site_days_with_context(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("site"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("mean_volume"))
    return external.site_context(s, context_days(spark, d))
