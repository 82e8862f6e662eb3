"""The report's result sets over a small run with known answers."""

import datetime as dt
import json

import pytest

from flowtally.config import Settings
from flowtally.plans import datasets


@pytest.fixture(scope="module")
def inputs(spark):
    months = [f"{y}-{m:02d}" for y in (2018, 2019, 2020, 2021) for m in range(1, 13)]
    months = [m for m in months if "2018-10" <= m <= "2021-01" and m not in ("2020-11", "2020-12")]
    rows = []
    for site in (1, 2, 3):
        for i, m in enumerate(months):
            v = 100.0 * site + i
            if m == "2020-03":
                v = 50.0 * site
            rows.append((m, site, v, 0.9, 0.5 if (site, m) == (3, "2020-02") else 0.95))
    monthly = spark.createDataFrame(rows, "year_month string, site long, mean_volume double, detector_coverage double, temporal_coverage double")
    named = spark.createDataFrame([(1, "2019-01", " "), (1, "2019-02", "A"), (1, "2019-03", "B"), (2, "2019-01", None), (3, "2019-01", "C")], "site long, year_month string, name string")
    day = dt.date(2019, 1, 1)
    days = spark.createDataFrame([(day + dt.timedelta(i), None if i == 9 else 10.0 + (30.0 if i == 3 else i % 7), "New Year" if i == 0 else None, "Fair" if i in (0, 3) else "") for i in range(60)], "date date, value double, holiday_name string, event_names string")
    hours = spark.createDataFrame([(1, 0, 8, 10.0, 2), (2, 0, 8, 20.0, 2)], "site long, weekday int, hour int, volume_sum double, observations long")
    sides = spark.createDataFrame([("2019-01", 1, s, v, 10, 0.9) for s, v in (("south", 10.0), ("west", 20.0), ("north", 30.0), ("east", 40.0))] + [("2019-01", 2, "south", 5.0, 10, 0.9)], "year_month string, site long, approach string, mean_volume double, observations long, coverage double")
    nodes = spark.createDataFrame([(1, 1, 2.0, 110.0, 26), (2, 1, 2.0, 210.0, 26), (3, 2, 0.0, 310.0, 25), (4, 2, None, None, 0)], "site long, community int, weighted_degree double, mean_volume double, trusted_months long")
    edges = spark.createDataFrame([(1, 2, 2.0)], "src long, dst long, weight double")
    sources = spark.createDataFrame([(m, "Complete") for m in months] + [("2020-11", "Missing"), ("2020-12", "Partial")], "year_month string, status string")
    factors = spark.createDataFrame([("friday_weekend", 1.0), ("hot_day_35c", 2.0)], "factor string, mean_difference double")
    located = spark.createDataFrame([(1, 32.6, 51.6, "high"), (2, 32.7, 51.7, "low"), (3, None, 51.7, "medium")], "site long, lat double, lon double, confidence string")
    channels = spark.createDataFrame([(1, 1, 100, 20), (1, 2, 100, 30)], "site long, channel int, observations long, invalid long")
    return datasets.Inputs(monthly, named, days, hours, sides, nodes, edges, sources, factors, located, channels)


def test_sets(inputs):
    sets = datasets.datasets(inputs)
    got = json.loads(datasets.artifact(sets))["datasets"]
    assert len(got) == 20
    head = got["headline"][0]
    assert head["invalid_rate"] == 0.25 and head["observed_days"] == 59 and head["calendar_days"] == 60 and head["graph_edges"] == 1 and head["map_coverage"] == 0.25
    assert head["shock_change_sites"] == 2 and head["latest_change_sites"] == 3 and head["trusted_site_months"] == 77
    city = {r["year_month"]: r for r in got["city_monthly"]}
    assert len(city) == 28 and "sites" in city["2020-11"] and city["2020-11"]["sites"] is None and city["2020-12"]["source_status"] == "Partial" and city["2020-02"]["sites"] == 2
    by = {r["site"]: r for r in got["site_summary"]}
    assert by[1]["label"] == "SCATS 1 — A" and by[2]["label"] == "SCATS 2" and by[4]["label"] is None and by[4]["months"] is None
    assert by[1]["shock_change"] == pytest.approx(50 / 116 - 1) and by[3]["shock_change"] is None and by[3]["before_months"] == 13
    assert by[1]["regime"] == "Review" and [by[k]["centrality_rank"] for k in (1, 2, 3, 4)] == [1, 1, 3, None] and by[3]["volume_rank"] == 1
    assert got["context_effects"] == [{"factor": "hot_day_35c", "mean_difference": 2.0, "factor_label": "Hot Day 35C"}]
    trend = {r["date"]: r for r in got["daily_trend"]}
    assert trend["2019-01-01"]["context_note"] == "Fair" and trend["2019-01-10"]["traffic_status"].startswith("Missing") and trend["2019-01-10"]["day_index"] is None
    odd = got["anomaly_dates"]
    assert odd and len(odd) == len({r["date"] for r in odd}) and [r["direction"] for r in odd if r["date"] == "2019-01-04"] == ["High"]
    assert [r["site"] for r in got["map_points"]] == [1]
    assert {r["community"]: r["most_central"] for r in got["community_summary"]} == {1: "SCATS 1 — A", 2: "SCATS 3 — C"}
    assert [r["site"] for r in got["approach_shares"]] == [1] and got["approach_shares"][0]["east_share"] == 0.4
    assert len(got["hour_week_heatmap"]) == 7 and {r["weekday_name"] for r in got["hour_week_heatmap"]} == {"Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"}
    assert {r["month_name"] for r in got["seasonality"]} >= {"Jan", "Dec"} and {r["common_panel_sites"] for r in got["seasonality"]} == {3}
    assert [r["site"] for r in got["shock_rank"]] == [2, 1] or [r["site"] for r in got["shock_rank"]] == [1, 2]
    with pytest.raises(ValueError):
        datasets.artifact({"days": sets["daily_trend"]}, most=5)


def test_checks(inputs):
    r = datasets.checks(inputs, Settings(), least=(2, 3, 3)).first()
    assert r.passed and r.monthly_repeats == r.day_repeats == r.node_repeats == 0 and r.shock_change_sites == 2
    assert not datasets.checks(inputs).first().passed


def test_empty(inputs):
    from dataclasses import fields, replace

    none = replace(inputs, **{f.name: getattr(inputs, f.name).limit(0) for f in fields(inputs)})
    got = json.loads(datasets.artifact(datasets.datasets(none)))["datasets"]
    assert len(got["headline"]) == 1 and got["headline"][0]["map_coverage"] is None and got["site_summary"] == [] and len(got["hour_week_heatmap"]) == 7


def test_insights_and_explorer(inputs, spark):
    sets = datasets.datasets(inputs)
    i = datasets.insights(sets, datasets.Periods(focus_site=2)).first()
    assert (i.sites_declining, i.shock_change_sites, i.peak_weekday, i.peak_hour, i.peak_mean_volume) == (2, 2, 0, 8, 7.5)
    assert (i.focus_volume_place, i.focus_volume_place_of, i.focus_link_place) == (2, 3, 2)
    s = datasets.run_summary(inputs).first()
    assert (s.first_month, s.last_month, s.missing_source_months, s.graph_edges, s.invalid_rate, s.sites) == ("2018-10", "2021-01", "2020-11", 1, 0.25, 3)
    assert s.largest_fall_month == "2020-03" and s.most_linked_site == 1
    payload = json.loads(datasets.explorer_payload(sets))
    assert len(payload["charts"]) == 8 and sorted(c for x in payload["sections"] for c in x["charts"]) == sorted(payload["charts"])
    assert {d["id"]: d["count"] for d in payload["datasets"]} == {n: d.count() for n, d in sets.items()}
    line = payload["charts"]["monthly"]["traces"]["all"]
    city = dict(zip((x[:7] for x in line["x"]), line["y"]))
    assert len(city) == 28 and city["2020-11"] is None and city["2020-12"] is None and city["2020-01"] is not None
    pairs = payload["charts"]["shock_recovery"]["traces"]
    assert {(float(x), y) for t in pairs.values() for x, y in zip(t["x"], t["y"])} == {(r.shock_change, r.recovery_change) for r in sets["shock_recovery"].collect()}
    focus = datasets.datasets(inputs, p=datasets.Periods(focus_site=1))
    sides = json.loads(datasets.explorer_payload(focus))["charts"]["approaches"]["traces"]
    assert {t for t in sides if "partial" not in t} == {"South", "West", "North", "East"} and sum("partial" in t for t in sides) == 4
    for t, trace in sides.items():
        values = dict(zip((x[:7] for x in trace["x"]), trace["y"]))
        assert set(values) == {"2020-12"} if "partial" in t else values["2020-12"] is None is values["2020-11"]
    found = datasets.map_sites(sets["site_summary"].select("site"), spark.createDataFrame([(1, 1.0, 1.0, "low", "direct_name"), (2, 1.0, 1.0, "medium", "street_pair"), (3, 1.0, 1.0, "high", "street_pair")], "site long, lat double, lon double, confidence string, method string"))
    assert {r.site: r.reliable for r in found.collect()} == {1: True, 2: False, 3: True, 4: False}


def test_means_of_copies_are_equal(spark, monkeypatch):
    import random

    from flowtally.plans import catalogue

    months = [(f"1995-{m:02d}", 10.0**k + 0.1) for m, k in zip(range(1, 11), (9, 0, -3, 7, 2, -1, 8, 1, 5, -2), strict=True)]
    rows = [(s, m, v) for s in range(1, 9) for m, v in random.Random(s).sample(months, len(months))]
    random.Random(0).shuffle(rows)
    monkeypatch.setattr(catalogue, "panel", lambda spark, d: spark.createDataFrame(rows, "site long, year_month string, mean_volume double").repartition(7))
    suppliers = spark.createDataFrame([(s, 1, 1.0) for s in range(1, 9)], "s_suppkey long, s_nationkey int, s_acctbal double")
    monkeypatch.setattr(catalogue, "table", lambda spark, d, name: suppliers)
    assert len({r.mean_volume for r in catalogue.nodes(spark, "").collect()}) == 1  # so that they share a rank
