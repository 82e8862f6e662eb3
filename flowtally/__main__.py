"""Command line: python -m flowtally metadata|geocode|ingest|follow|analyze|context|report|all --out DIR, and the inputs of each step.

metadata: --raw [--registry --diagrams --boxes --overrides]; geocode: --candidates [--sites]; ingest: --raw [--detectors
--force]; follow: as ingest, but files that came, changed or went since the last time replace their months (not in `all`);
analyze: what ingest wrote; context: --weather --policy --holidays --events, and what analyze wrote if it is there;
report: what the others wrote. What an input leaves out is taken from earlier steps. all: those steps whose inputs are given.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Periods, Settings
from .functions import scalars as S
from .operators import changes, context, detectors, external, graph, normalize, panels, profiles, quality, shape
from .plans import datasets, manifest
from .session import lineage_cut, session
from .sources import diagrams, records, tables, workbook
from .streaming import ingest as incremental


def _put(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def metadata(spark: SparkSession, raw: str, out: str, s: Settings, registry: str | None = None, boxes: str | None = None, overrides: str | None = None, drawings: str | None = None) -> None:
    """What is known of channels and sites, under {out}: channel_quality and site_records of the logs; source_files with
    their hashes; sites, from the workbook under `registry`; diagrams, the boxes in the PNG files under `drawings` (or boxes,
    a CSV of site, x, y); detectors, the channels' approaches by them and overrides (CSV of site, channel, approach,
    verification, source_note); inventory."""
    got = records.read(spark, raw, sentinels=s.sentinels)
    each = got.select(F.col("site_id").alias("site"), F.explode("channels").alias("channel", "value"))
    profile = _put(quality.channels(each, s.operational_readings), f"{out}/channel_quality")
    seen = _put(quality.site_records(got.select(F.col("site_id").alias("site"))), f"{out}/site_records")
    hashes = tables.file_hashes(spark, raw).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "sha256")
    _put(records.file_months(got).join(hashes, "source_file", "left"), f"{out}/source_files")
    empty = lambda schema: spark.createDataFrame([], schema)
    sites = _put(workbook.read_registry(spark, registry) if registry else empty("site long, name string, gis_id long, registry_source string"), f"{out}/sites")
    drawn = seen_on = spark.read.csv(boxes, header=True, schema="site long, x double, y double") if boxes else empty("site long, x double, y double")
    if drawings:
        seen_on = _put(diagrams.read(spark, drawings), f"{out}/diagrams")  # a diagram without boxes is one
        drawn = diagrams.each(seen_on)
    own = spark.read.csv(overrides, header=True, schema="site long, channel int, approach string, verification string, source_note string") if overrides else None
    _put(detectors.registry(profile, detectors.box_counts(drawn), s.operational_readings, own), f"{out}/detectors")
    _put(detectors.inventory(seen, sites, seen_on).join(seen, "site", "left"), f"{out}/inventory")


def ingest(spark: SparkSession, raw: str, channels: DataFrame, out: str, s: Settings, force: bool = False) -> None:
    """Normalized facts, as {out}/fact by the month of their file, and an audit of every file, as {out}/tables/source_quality.
    Months that are there stay, but with force. channels: (site_id, channel_id, approach, operational)."""
    got = records.read(spark, raw, sentinels=s.sentinels)
    month = records.file_months(got).select("source_file", F.col("source_month").alias("year_month"))
    if not force and incremental.exists(spark, f"{out}/fact"):
        month = month.join(spark.read.parquet(f"{out}/fact").select(F.col("year_month").cast("string")).distinct(), "year_month", "left_anti")
    tables.write_months(incremental.facts(got, month, channels, s.minimum_detector_coverage), f"{out}/fact")
    _audit(spark, out)


def follow(spark: SparkSession, raw: str, channels: DataFrame, out: str, s: Settings) -> None:
    """What ingest() does, for the files that came, changed or went since follow() last ran: their months are made anew. What it knows
    is under {out}/state; it can be broken off and run again at any time."""
    incremental.note_arrivals(spark, raw, f"{out}/state")
    query = incremental.follow(spark, channels, f"{out}/state", out, s.minimum_detector_coverage, s.sentinels)
    query.awaitTermination()
    _audit(spark, out)


def _audit(spark: SparkSession, out: str) -> None:
    every = spark.read.parquet(f"{out}/fact").select("source_file", "ts", F.col("site_id").alias("site"), F.col("volume_normalized").alias("value"))
    _put(quality.source_files(every, PER_DAY), f"{out}/tables/source_quality")


def analyze(spark: SparkSession, out: str, s: Settings) -> None:
    """Profiles, panels, changes, similarity graph and shape clusters of {out}/fact, as {out}/tables/*."""

    put = lambda df, name: _put(df, f"{out}/tables/{name}")

    # A closing record of the next month's midnight is in a file, but not of its month.
    raw = spark.read.parquet(f"{out}/fact").where(S.month(F.col("ts")) == F.col("year_month").cast("string"))
    fact = raw.select(F.col("site_id").alias("site"), "ts", F.col("volume_normalized").alias("value"), F.col("detector_coverage").alias("coverage"))
    each = raw.select(F.col("site_id").alias("site"), "ts", F.inline(F.array(*[F.struct(F.lit(x).alias("approach"), F.col(f"{x}_volume").cast("double").alias("volume"), F.col(f"{x}_coverage").alias("coverage")) for x in normalize.SIDES])))
    monthly = put(profiles.monthly(fact), "site_monthly")
    put(profiles.daily(fact), "site_daily")
    put(profiles.approaches(each), "approach_monthly")
    hours = put(profiles.hour_of_week(fact), "hour_of_week")
    panel = panels.trusted(monthly, s.trusted_temporal_coverage, s.trusted_detector_coverage)
    put(panels.city_monthly(panel), "city_monthly")
    put(panels.month_of_year(panels.common(panel, s.baseline_year)), "month_of_year")
    put(panels.month_by_year(panel), "month_by_year")
    put(changes.summarized(changes.adjacent(panel)), "paired_month_changes")
    week = graph.standardized(hours.select("site", "bin", F.col("mean_volume").alias("value")), 126)
    nodes = week.select("site")
    edges = put(graph.neighbour_edges(week, s.graph_neighbors, s.graph_minimum_correlation), "graph_edges")
    # Shapes of days pool the weekdays.
    pooled = hours.groupBy("site", F.col("hour").alias("bin")).agg((F.sum("volume_sum") / F.sum("observations")).alias("value"))
    cluster = shape.clusters(graph.standardized(pooled, 20, constant=True), s.dtw_window)
    volume = panel.groupBy("site").agg(S.mean_in_order(F.col("mean_volume"), F.col("year_month")).alias("mean_volume"), F.count("*").alias("trusted_months"))
    j = graph.degrees(nodes, edges)
    for more in (graph.betweenness(nodes, edges), graph.eigenvector(nodes, edges), graph.communities(nodes, edges), cluster.withColumnRenamed("cluster", "dtw_cluster").drop("silhouette"), volume):
        j = j.join(more, "site", "left")
    nodes = put(j, "graph_nodes")
    parts = graph.connected(nodes, edges)
    put(graph.metadata(nodes, edges, nodes.select("site", "community"), parts), "graph_metadata")
    first, last = raw.agg(F.min("year_month").cast("string"), F.max("year_month").cast("string")).first()
    if first:
        every = raw.select("ts", F.col("site_id").alias("site"), F.col("volume_normalized").alias("value"))
        put(quality.source_months(every, PER_DAY, f"{first}-01", f"{last}-01"), "source_months")


def geocode(spark: SparkSession, sites: str | None, candidates: str, out: str, s: Settings) -> None:
    """Places of the sites (CSV of site, name; else {out}/sites) from a gazetteer's candidates (CSV), as {out}/sites_geocoded.
    Sites that were found before keep their place, if their name is the same."""
    named = spark.read.csv(sites, header=True, schema="site long, name string") if sites else spark.read.parquet(f"{out}/sites").select("site", "name")
    found = spark.read.csv(candidates, header=True, schema="query string, rank int, lat double, lon double, osm_type string, osm_id string, display_name string")
    new = detectors.geocoded(named, found, s.geocode_place, list(s.street_prefixes), s.geocode_bbox)
    if incremental.exists(spark, f"{out}/sites_geocoded"):
        old = spark.read.parquet(f"{out}/sites_geocoded").where("geocode_method IN ('direct_name', 'street_pair')").join(named, ["site", "name"], "left_semi")
        new = lineage_cut(new.join(old, "site", "left_anti").unionByName(old.select(*new.columns)))
    _put(new, f"{out}/sites_geocoded")


def add_context(spark: SparkSession, weather: str, policy: str, holidays: str, events: str, out: str, s: Settings) -> None:
    """Daily and monthly context and its checks, and joined to {out}/tables/site_daily if that is there, as {out}/tables/*."""

    put = lambda df, name: _put(df, f"{out}/tables/{name}")

    dates = context.spine(spark, s.context_start, s.context_end)
    series = put(tables.read_policy(spark, policy, external.POLICY, s.policy_country), "policy_series")
    days = external.daily(
        external.calendar(dates, spark.read.csv(holidays, header=True, schema="date date, name_en string, name_fa string"), s.ramadan_windows),
        external.weather_days(tables.read_weather(spark, weather)), external.policy_days(dates, series), external.event_days(dates, tables.read_events(spark, events)),
    )
    days = put(days, "daily_context")
    put(external.months(days), "context_monthly")
    put(external.checks(days, dates, series), "context_quality")
    if incremental.exists(spark, f"{out}/tables/site_daily"):
        site_days = spark.read.parquet(f"{out}/tables/site_daily")
        put(external.site_context(site_days, days), "site_daily_with_context")
        city = put(external.city_context(site_days, days, s.trusted_temporal_coverage), "city_daily_with_context")
        put(external.associations(city), "context_associations")


def report(spark: SparkSession, out: str, s: Settings, periods: Periods = Periods()) -> None:
    """The report's result sets, their checks, insights, the run's summary and the explorer, of what is under {out}; all as
    {out}/report/*, with the texts report.json (the sets), manifest.json (how they are shown), short.json (the short report: its sets
    and manifest), about.json, explorer.json and developer.json. Steps that were left out leave their sets empty."""

    def of(name: str, schema: str, **renamed: str) -> DataFrame:
        path = f"{out}/{name}"
        return spark.read.parquet(path).withColumnsRenamed(renamed) if incremental.exists(spark, path) else spark.createDataFrame([], schema)

    city = of("tables/city_daily_with_context", "date date, city_median_15min_volume double, official_holiday_name_en string, manual_event_names string")
    days = city.select("date", F.col("city_median_15min_volume").alias("value"), F.col("official_holiday_name_en").alias("holiday_name"), F.col("manual_event_names").alias("event_names"))
    place = of("sites_geocoded", "site long, latitude double, longitude double, geocode_confidence string, geocode_method string")
    located = place.select("site", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("geocode_confidence").alias("confidence"), F.col("geocode_method").alias("method"))
    named = of("sites", "site long, name string").select("site", F.lit("").alias("year_month"), "name")
    tables_ = {n: of(f"tables/{n}", c) for n, c in {"site_monthly": "", "hour_of_week": "", "approach_monthly": "", "graph_nodes": "", "graph_edges": "", "source_months": "year_month string, status string, coverage double"}.items()}
    factors = of("tables/context_associations", "factor string, adjusted_index_difference_points double", context_factor="factor")
    x = datasets.Inputs(tables_["site_monthly"], named, days, tables_["hour_of_week"], tables_["approach_monthly"], tables_["graph_nodes"], tables_["graph_edges"], tables_["source_months"], factors, located.drop("method"), of("channel_quality", "observations long, invalid long, operational boolean"))
    sets = {n: _put(d, f"{out}/report/{n}") for n, d in datasets.datasets(x, s, periods).items()}
    about = {"checks": datasets.checks(x, s, periods), "insights": datasets.insights(sets, periods), "summary": datasets.run_summary(x, s)}
    about = {n: _put(d, f"{out}/report/{n}") for n, d in about.items()}
    _put(datasets.explorer(sets), f"{out}/report/explorer")
    _put(datasets.map_sites(sets["site_summary"], located), f"{out}/report/map_sites")
    whole = manifest.manifest(sets)
    texts = {
        "report": datasets.artifact(sets), "about": datasets.artifact(about), "explorer": datasets.explorer_payload(sets), "manifest": manifest.text(whole), "short": manifest.text({**manifest.report_manifest(whole), **json.loads(datasets.artifact({n: sets[n] for n in manifest.REPORT["sets"]}))}),
        "developer": manifest.text(manifest.developer_view(sets, about["checks"], s)),
    }
    for name, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report/{name}.json")


#: Readings a day.
PER_DAY = 96
#: The inputs that each step needs, in the order of the steps.
NEEDS = {"metadata": ("raw",), "geocode": ("candidates",), "ingest": ("raw",), "follow": ("raw",), "analyze": (), "context": ("weather", "policy", "holidays", "events"), "report": ()}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="flowtally")
    p.add_argument("command", choices=[*NEEDS, "all"])
    p.add_argument("--raw")
    p.add_argument("--registry", help="folder of the sites' workbook")
    p.add_argument("--diagrams", help="folder of the sites' diagrams, PNG files named by site")
    p.add_argument("--boxes", help="CSV with site, x, y of the diagrams' boxes, in place of the diagrams")
    p.add_argument("--overrides", help="CSV with site, channel, approach, verification, source_note")
    p.add_argument("--detectors", help="CSV with site_id, channel_id, approach, operational; else what metadata wrote")
    p.add_argument("--sites", help="CSV with site, name; else what metadata wrote")
    p.add_argument("--candidates", help="CSV with query, rank, lat, lon, osm_type, osm_id, display_name")
    p.add_argument("--weather", help="JSON of hourly columns")
    p.add_argument("--policy", help="CSV of policy levels by country and day")
    p.add_argument("--holidays", help="CSV with date, name_en, name_fa")
    p.add_argument("--events", help="CSV of dated events")
    p.add_argument("--out", required=True)
    p.add_argument("--settings")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    every = a.command == "all"
    lacks = lambda step: [n for n in NEEDS[step] if not getattr(a, n)]
    for step in ("metadata", "ingest") if every else (a.command,):
        if lacks(step):
            p.error(" and ".join(f"--{n}" for n in lacks(step)) + " needed")
    spark, s = session(), Settings.load(a.settings) if a.settings else Settings()
    for step in [k for k in NEEDS if not lacks(k) and k != "follow"] if every else [a.command]:
        if step == "metadata":
            metadata(spark, a.raw, a.out, s, a.registry, a.boxes, a.overrides, a.diagrams)
        elif step == "geocode":
            geocode(spark, a.sites, a.candidates, a.out, s)
        elif step in ("ingest", "follow"):
            schema = "site_id int, channel_id int, approach string, operational string"
            own = spark.read.parquet(f"{a.out}/detectors").selectExpr("CAST(site AS INT) site_id", "CAST(channel AS INT) channel_id", "approach", "CAST(operational AS STRING) operational") if not a.detectors else None
            channels = spark.read.csv(a.detectors, header=True, schema=schema) if a.detectors else own
            if step == "follow":
                follow(spark, a.raw, channels, a.out, s)
            else:
                ingest(spark, a.raw, channels, a.out, s, a.force)
        elif step == "analyze":
            analyze(spark, a.out, s)
        elif step == "context":
            add_context(spark, a.weather, a.policy, a.holidays, a.events, a.out, s)
        else:
            report(spark, a.out, s)


if __name__ == "__main__":
    main()
