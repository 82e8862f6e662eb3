"""Daily context and places of sites: fixtures worked out by hand, and both steps of the command line."""

import csv
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowtally import __main__ as cli
from flowtally.config import Settings
from flowtally.operators import context, detectors, external
from flowtally.sources import tables


@pytest.fixture
def inputs(tmp_path):
    start = dt.datetime(2020, 3, 18)
    times = [start + dt.timedelta(hours=h) for h in range(24 * 5)]
    hourly = {"time": [t.strftime("%Y-%m-%dT%H:%M") for t in times]} | {f: [1.0] * len(times) for f in tables.WEATHER}
    hourly["precipitation"] = [0.5 if t.day == 19 else None if t.day == 20 else 0.0 for t in times]
    hourly["temperature_2m"] = [36.0 if t.day == 19 and t.hour == 12 else -1.0 if t.day == 20 else 10.0 for t in times]
    (tmp_path / "weather.json").write_text(json.dumps({"latitude": 32.5, "longitude": 51.5, "elevation": 1590.0, "hourly": hourly}))
    with open(tmp_path / "policy.csv", "w", newline="") as f:
        w = csv.writer(f)
        names = list(external.POLICY)
        w.writerow(["CountryCode", "Jurisdiction", "Date", "Other", *names])
        row = lambda c, j, d, level, cases: w.writerow([c, j, d, "x", *[cases if n.startswith("Confirmed") else level for n in names]])
        row("IRN", "NAT_TOTAL", "20200319", 0, 5)
        row("IRN", "NAT_TOTAL", "20200319", 1, 7)  # the last row of a date wins
        row("IRN", "NAT_TOTAL", "20200322", 2, 9)
        row("IRN", "STATE_TOTAL", "20200320", 3, 99)
        row("XXX", "NAT_TOTAL", "20200320", 3, 99)
    (tmp_path / "holidays.csv").write_text("date,name_en,name_fa\n2020-03-20,New Year,نوروز\n")
    (tmp_path / "events.csv").write_text("date_start,date_end,event_type,event_name,event_scope,location,source_url,source_confidence,notes\n2020-03-21,2020-03-30,b,two,,,,High,\n2020-03-21,2020-03-21,a,one,,,,odd,\n")
    return tmp_path


def test_context(spark, inputs, monkeypatch):
    out = str(inputs / "out")
    vol = [(1, "2020-03-18", 100.0, 1.0), (2, "2020-03-18", 300.0, 0.9), (3, "2020-03-18", 900.0, 0.5), (1, "2020-03-19", 50.0, 1.0)]
    site_days = spark.createDataFrame(vol, "site int, date string, mean_volume double, temporal_coverage double").withColumns({"date": F.to_date("date"), "total_volume": F.col("mean_volume") * 96})
    site_days.write.parquet(f"{out}/tables/site_daily")
    (inputs / "settings.json").write_text(json.dumps({"context_start": "2020-03-18", "context_end": "2020-03-22", "ramadan_windows": [["2020-03-21", "2020-03-22"]]}))
    monkeypatch.setattr(cli, "session", lambda: spark)
    given = [x for k, f in (("weather", "weather.json"), ("policy", "policy.csv"), ("holidays", "holidays.csv"), ("events", "events.csv"), ("settings", "settings.json")) for x in (f"--{k}", str(inputs / f))]
    cli.main(["context", "--out", out, *given])
    read = lambda n: spark.read.parquet(f"{out}/tables/{n}")
    d = {r.date.day: r for r in read("daily_context").collect()}
    assert sorted(d) == [18, 19, 20, 21, 22]
    assert (d[20].jalali_date, d[20].jalali_month_name_en, d[20].is_official_holiday, d[20].official_holiday_name_en, d[21].official_holiday_name_en) == ("1399-01-01", "Farvardin", 1, "New Year", "")
    assert [d[k].days_to_nearest_official_holiday for k in sorted(d)] == [2, 1, 0, 1, 2] and [d[k].is_ramadan_approx for k in sorted(d)] == [0, 0, 0, 1, 1]
    assert (d[19].weather_hour_count, d[19].precipitation_sum_mm, d[19].wet_hours, d[19].is_heavy_precipitation_day, d[19].is_hot_day) == (24, 12.0, 24, 1, 1)
    assert (d[20].precipitation_sum_mm, d[20].wet_hours, d[20].is_wet_day, d[20].is_freezing_day) == (None, 0, 0, 1)
    assert [d[k].covid_data_available for k in sorted(d)] == [0, 1, 0, 0, 1]
    assert [d[k].covid_stay_home_level for k in sorted(d)] == [0.0, 1.0, None, None, 2.0]
    assert [d[k].covid_confirmed_cases_cumulative for k in sorted(d)] == [0.0, 7.0, 7.0, 7.0, 9.0] and [d[k].covid_new_cases_derived for k in sorted(d)] == [0.0, 7.0, 0.0, 0.0, 2.0]
    assert [d[k].covid_any_mobility_restriction for k in sorted(d)] == [0, 1, 0, 0, 1]
    assert [(d[k].manual_event_count, d[k].manual_event_names, d[k].manual_event_confidence_rank) for k in (20, 21, 22)] == [(0, "", 0), (2, "one | two", 3), (1, "two", 3)]
    m = read("context_monthly").first()
    assert (m.calendar_days, m.manual_event_days, m.precipitation_sum_mm, m.covid_mobility_restriction_days, m.covid_stringency_mean) == (5, 2, 12.0, 2, 1.0)
    q = read("context_quality").first()
    assert (q.daily_rows, q.expected_daily_rows, q.duplicate_dates, q.weather_missing_days, q.covid_missing_days_inside_source_window, q.passed) == (5, 5, 0, 1, 2, False)
    c = {r.date.day: r for r in read("city_daily_with_context").collect()}
    assert (c[18].trusted_intersection_count, c[18].city_median_15min_volume, c[18].traffic_data_available, c[20].traffic_data_available) == (2, 200.0, 1, 0)
    assert read("site_daily_with_context").count() == 4
    a = {r.context_factor: r for r in read("context_associations").collect()}
    assert set(a) == set(external.FACTORS)
    wet = a["wet_weather"]
    assert (wet.flagged_days_with_traffic, wet.comparison_days_with_traffic, wet.flagged_mean_raw_15min_volume, wet.flagged_mean_adjusted_volume_index) == (1, 1, 50.0, 100.0)
    assert wet.month_adjusted_index_difference_points == pytest.approx(100 * 50 / 125 - 100 * 200 / 125)
    assert a["official_holiday"].flagged_mean_raw_15min_volume is None


def test_empty_sources(spark, inputs):
    days = context.spine(spark, "2020-03-18", "2020-03-19")
    none = tables.read_policy(spark, str(inputs / "policy.csv"), external.POLICY, "ZZZ")
    assert [(r.covid_data_available, r.covid_new_cases_derived, r.covid_stay_home_level) for r in external.policy_days(days, none).collect()] == [(0, 0.0, None)] * 2
    with pytest.raises(Exception, match="repeated key"):
        external.daily(days, days.union(days).withColumn("v", F.col("date"))).collect()
    (inputs / "bad.json").write_text(json.dumps({"hourly": {"time": ["2020-01-01T00:00"]} | {f: [1.0] for f in tables.WEATHER[1:]}}))
    with pytest.raises(ValueError, match="temperature_2m"):
        tables.read_weather(spark, str(inputs / "bad.json"))


def test_geocoded(spark):
    box = Settings().geocode_bbox
    sites = spark.createDataFrame([(1, "Alpha"), (2, "سه راه Beta - Gamma"), (3, "Beta / Far"), (4, ""), (5, None), (6, "Nowhere")], "site int, name string")
    rows = [
        ("Alpha, X", 1, 40.0, 51.7, "node", "9", "outside"), ("Alpha, X", 2, 32.6, 51.7, "node", "1", "a"), ("Alpha, X", 3, 32.7, 51.7, "node", "2", "b"),
        ("Beta, X", 1, 32.60, 51.60, "way", "3", "beta"), ("Beta, X", 2, 32.65, 51.60, "way", "4", "beta 2"), ("Gamma, X", 1, 32.651, 51.60, "way", "5", None), ("Far, X", 1, 32.75, 51.80, "way", "6", "far"),
    ]
    found = spark.createDataFrame(rows, "query string, rank int, lat double, lon double, osm_type string, osm_id string, display_name string")
    got = {r.site: r for r in detectors.geocoded(sites, found, "X", list(Settings().street_prefixes), box).collect()}
    assert len(got) == 6
    assert (got[1].latitude, got[1].geocode_method, got[1].geocode_confidence, got[1].osm_id, got[1].match_distance_m) == (32.6, "direct_name", "medium", "1", 0.0)
    assert (got[2].geocode_method, got[2].geocode_confidence, got[2].geocode_query, got[2].osm_id, got[2].display_name) == ("street_pair", "high", "Beta, X | Gamma, X", "4|5", "beta 2 | ")
    assert got[2].latitude == pytest.approx(32.6505) and got[2].match_distance_m == pytest.approx(111.2, abs=0.1)
    assert [(got[k].geocode_method, got[k].geocode_confidence, got[k].latitude) for k in (3, 6, 4, 5)] == [("unmatched", "none", None)] * 2 + [(None, None, None)] * 2


def test_geocode_step(spark, tmp_path, monkeypatch):
    (tmp_path / "sites.csv").write_text("site,name\n1,A\n")
    (tmp_path / "found.csv").write_text(f'query,rank,lat,lon,osm_type,osm_id,display_name\n"A, {Settings().geocode_place}",1,32.6,51.6,node,1,x\n')
    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main(["geocode", "--sites", str(tmp_path / "sites.csv"), "--candidates", str(tmp_path / "found.csv"), "--out", str(tmp_path)])
    assert spark.read.parquet(f"{tmp_path}/sites_geocoded").first().geocode_method == "direct_name"
