"""Named result sets of a reporting run, each a small DataFrame over facts that are grouped once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Periods, Settings
from ..functions import scalars as S
from ..operators import changes, context, panels, profiles, quality
from ..operators.line import Line

VALUE = "mean_volume"


def site_labels(named: DataFrame) -> DataFrame:
    """(site, name, label): the first name that isn't blank by month; named: (site, year_month, name)."""
    some = F.when(F.trim("name") != "", F.col("year_month"))
    g = named.groupBy("site").agg(F.coalesce(F.min_by("name", some), F.lit("")).alias("name"))
    return g.withColumn("label", F.concat(F.lit("SCATS "), F.col("site").cast("string"), F.when(F.trim("name") != "", F.concat(F.lit(" — "), F.col("name"))).otherwise("")))


def site_changes(panel: DataFrame, p: Periods, limit: float = 0.5) -> DataFrame:
    """One row per site of the panel: months, mean, variation, medians before and after, changes between named months and
    the largest step between months in a row. Window and aggregate share the partitioning by site: one shuffle."""
    v = F.col(VALUE)
    at = lambda m: F.max(F.when(F.col("year_month") == m, v))
    inside = lambda span: F.when(F.col("year_month").between(*span), v)
    g = changes.consecutive(panel, VALUE).groupBy("site").agg(
        F.count("*").alias("months"), S.mean_in_order(v, F.col("year_month")).alias("site_mean"), F.stddev_samp(v).alias("site_std"), F.max(F.abs("change")).alias("max_abs_change"),
        F.median(inside(p.before)).alias("before_median"), F.count(inside(p.before)).alias("before_months"), F.median(inside(p.after)).alias("after_median"), F.count(inside(p.after)).alias("after_months"),
        S.ratio(at(p.shock[1]), at(p.shock[0])).alias("shock_change"), S.ratio(at(p.recovery[1]), at(p.recovery[0])).alias("recovery_change"), S.ratio(at(p.latest[1]), at(p.latest[0])).alias("latest_change"),
    )
    return g.withColumns({"cv": F.col("site_std") / F.when(F.col("site_mean") != 0, F.col("site_mean")), "after_vs_before": S.ratio(F.col("after_median"), F.col("before_median")), "regime": F.when(F.col("max_abs_change") >= limit, "Review").otherwise(changes.STEADY)})


def site_summary(nodes: DataFrame, labels: DataFrame, site_change: DataFrame) -> DataFrame:
    """Graph nodes (site, community, weighted_degree, mean_volume, ...) with labels, changes and ranks; a site without a
    trusted month keeps its row."""
    j = nodes.join(labels, "site", "left").join(site_change, "site", "left").withColumn("community_label", F.concat(F.lit("Community "), F.col("community").cast("string")))
    return changes.ranked(changes.ranked(j, VALUE, "volume_rank"), "weighted_degree", "centrality_rank")


def city_months(panel: DataFrame, sources: DataFrame) -> DataFrame:
    """City series on the spine of source months (year_month, status), so that months without data show as gaps."""
    return sources.select("year_month", F.col("status").alias("source_status")).join(panels.city_monthly(panel), "year_month", "left").withColumn("month_date", F.concat("year_month", F.lit("-01")))


def daily_trend(days: DataFrame, year: int) -> DataFrame:
    """days (date, value, holiday_name, event_names, ...) with the day's index, its rolling median, a note (an event's
    before a holiday's) and whether traffic was seen."""
    note = lambda c: F.when(F.trim(c) != "", F.trim(c))
    d = context.daily_index(days, "value", year)
    return d.withColumns({"context_note": F.coalesce(note("event_names"), note("holiday_name"), F.lit("")), "traffic_status": F.when(F.col("value").isNotNull(), "Observed").otherwise("Missing / insufficient coverage")})


def anomaly_days(trend: DataFrame, low: int = 12, high: int = 8) -> DataFrame:
    """The days farthest below and above an index of 100, each once; direction is the sign of the deviation."""
    d = trend.where("day_index IS NOT NULL").withColumn("deviation", F.col("day_index") - 100)
    return changes.extremes(d, "deviation", "date", low, high).withColumn("direction", F.when(F.col("deviation") < 0, "Low").otherwise("High"))


def community_summary(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    n = nodes.join(labels, "site", "left")
    return n.groupBy("community").agg(
        F.count_distinct("site").alias("sites"), F.median(VALUE).alias("median_volume"), F.avg("weighted_degree").alias("mean_weighted_degree"), F.median("trusted_months").alias("median_trusted_months"),
        F.max_by("label", F.when(F.col("weighted_degree").isNotNull(), F.struct("weighted_degree", -F.col("site")))).alias("most_central"),
    ).withColumn("community_label", F.concat(F.lit("Community "), F.col("community").cast("string")))


def map_points(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """Nodes with coordinates of medium or high confidence; located: (site, lat, lon, confidence), one row a site."""
    ok = located.where(F.col("confidence").isin("medium", "high") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return nodes.join(quality.require_unique(ok, "site"), "site")


def map_sites(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """All nodes with what the geocoder found, and whether a map may show them: a match of the name itself, or a pair of
    streets of high confidence. located: (site, lat, lon, confidence, method), one row a site."""
    sure = (F.col("method") == "direct_name") | ((F.col("method") == "street_pair") & (F.col("confidence") == "high"))
    return nodes.join(quality.require_unique(located, "site"), "site", "left").withColumn("reliable", F.coalesce(sure & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.lit(False)))


@dataclass(frozen=True)
class Inputs:
    """Tables of a run: profiles.monthly(), names by month, city days with context, profiles.hour_of_week(),
    profiles.approaches(), graph nodes and edges, quality.source_months(), context.associations(), located sites and
    quality.channels()."""

    monthly: DataFrame
    named: DataFrame
    days: DataFrame
    hours: DataFrame
    sides: DataFrame
    nodes: DataFrame
    edges: DataFrame
    sources: DataFrame
    factors: DataFrame
    located: DataFrame
    channels: DataFrame


class Sets(Mapping):
    """Result sets by name, each made when it is first asked for."""

    def __init__(self, made: dict[str, Callable[[], DataFrame]]) -> None:
        self.made = {k: cache(f) for k, f in made.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self.made[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self.made)

    def __len__(self) -> int:
        return len(self.made)


def datasets(x: Inputs, settings: Settings = Settings(), p: Periods = Periods()) -> Sets:
    """All result sets by name; nothing runs until one of them is asked for."""
    panel = panels.trusted(quality.require_unique(x.monthly, "year_month", "site"), settings.trusted_temporal_coverage, settings.trusted_detector_coverage)
    labels = site_labels(x.named)
    change = site_changes(panel, p)
    summary = cache(lambda: site_summary(x.nodes, labels, change))
    trend = cache(lambda: daily_trend(x.days, settings.baseline_year))
    named = change.join(labels, "site", "left")
    common = panels.common(panel, settings.baseline_year)
    points = cache(lambda: map_points(summary(), x.located))
    both = named.where("shock_change IS NOT NULL AND recovery_change IS NOT NULL").join(x.nodes.select("site", "community", F.col(VALUE), "trusted_months"), "site", "left")
    month_name = F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMM")

    def headline() -> DataFrame:
        one = change.agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in ("shock_change", "recovery_change", "latest_change") for f, n in ((F.median, "median"), (F.count, "sites"))])
        rate = x.channels.agg((F.sum("invalid") / F.sum("observations")).alias("invalid_rate"))
        counts = [x.days.agg(F.count("value").alias("observed_days"), F.count("*").alias("calendar_days")), panel.agg(F.count("*").alias("trusted_site_months")), x.nodes.agg(F.count("*").alias("graph_nodes"), F.count_distinct("community").alias("communities")), x.edges.agg(F.count("*").alias("graph_edges")), map_points(x.nodes, x.located).agg(F.count("*").alias("mapped_sites"))]
        out = one.join(rate)
        for c in counts:
            out = out.join(c)  # one row each
        return out.withColumn("map_coverage", F.try_divide("mapped_sites", "graph_nodes"))

    return Sets({
        "headline": headline,
        "city_monthly": lambda: city_months(panel, x.sources),
        "paired_changes": lambda: changes.summarized(changes.adjacent(panel)).withColumn("period_label", F.concat_ws(" → ", "previous_month", "year_month")).withColumn("month_date", F.concat("year_month", F.lit("-01"))),
        "daily_trend": trend,
        "context_effects": lambda: x.factors.where(F.col("factor") != p.unadjusted_factor).withColumn("factor_label", S.title(F.col("factor"))),
        "seasonality": lambda: panels.month_of_year(common).withColumn("month_name", month_name).join(common.agg(F.count_distinct("site").alias("common_panel_sites"))),
        "shock_recovery": lambda: both.withColumn("community_label", F.concat(F.lit("Community "), F.col("community").cast("string"))),
        "shock_rank": lambda: named.where("shock_change IS NOT NULL").orderBy("shock_change", "site").limit(12),
        "latest_extremes": lambda: changes.extremes(named, "latest_change", "site", 8, 8),
        "month_heatmap": lambda: panels.site_baseline(panel, settings.baseline_year).where(F.col("year_month").between(f"{settings.baseline_year}-01", p.heatmap_end)),
        "hour_week_heatmap": lambda: profiles.heatmap(x.hours).withColumn("weekday_name", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("weekday")), "E")),
        "site_approaches": lambda: x.sides.where(F.col("site") == p.focus_site).withColumn("approach", F.initcap("approach")),
        "approach_shares": lambda: profiles.approach_shares(x.sides, ["south", "west", "north", "east"], settings.trusted_detector_coverage).join(labels, "site", "left"),
        "community_nodes": lambda: summary().select(*x.nodes.columns, "name", "label", "community_label"),
        "community_summary": lambda: community_summary(x.nodes, labels),
        "map_points": points,
        "source_quality": lambda: x.sources.withColumn("month_date", F.concat("year_month", F.lit("-01"))),
        "trusted_months": lambda: x.nodes.select("site", "trusted_months"),
        "site_summary": summary,
        "anomaly_dates": lambda: anomaly_days(trend()),
    })


def peak_cell(heatmap: DataFrame, base: int = 4) -> DataFrame:
    """One row: the weekday and hour with the highest mean of profiles.heatmap(), the earliest of equals, and how the mean of
    weekday `base` (4: Friday) differs from that of all hours of the others."""
    cells = heatmap.select("weekday", F.explode(F.array(*[F.struct(F.lit(h).alias("hour"), F.col(f"h{h:02d}").alias("v")) for h in range(24)])).alias("c")).select("weekday", "c.hour", "c.v")
    mean = lambda is_base: F.avg(F.when((F.col("weekday") == base) == is_base, F.col("v")))
    top = F.max_by(F.struct("weekday", "hour", "v"), F.when(F.col("v").isNotNull(), F.struct("v", -F.col("weekday"), -F.col("hour"))))
    g = cells.agg(top.alias("t"), (mean(True) / mean(False) - 1).alias("base_vs_others"))
    return g.select(F.col("t.weekday").alias("peak_weekday"), F.col("t.hour").alias("peak_hour"), F.col("t.v").alias("peak_mean_volume"), "base_vs_others")


def placed(df: DataFrame, by: str, site: str = "site") -> DataFrame:
    """df with `place` from 1 by falling values, ties by site: a position, so equal values don't share one; nulls come last."""
    line = Line(df, [F.col(by).desc_nulls_last(), F.col(site)])
    return line.rows.withColumn("place", F.col(line.n).cast("int")).drop(line.n)


def insights(sets: Mapping[str, DataFrame], p: Periods = Periods()) -> DataFrame:
    """One row of findings: sites that fell and rose, correlations, the peak of the week, effects of three factors, and the
    places, peak side and corridor share of the focus site."""
    summary, nodes, sides = sets["site_summary"], sets["community_nodes"], sets["site_approaches"]
    count = lambda c, sign, name: [F.count_if(sign(F.col(c))).alias(name), F.count(c).alias(f"{c}_sites")]
    out = summary.agg(*count("shock_change", lambda c: c < 0, "sites_declining"), *count("recovery_change", lambda c: c > 0, "sites_rising"), F.count_if(F.col("regime") == "Review").alias("review_sites"))
    average = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / F.lit(2.0)
    ranks = nodes.where(F.col(VALUE).isNotNull() & F.col("weighted_degree").isNotNull()).select(average(VALUE).alias("v"), average("weighted_degree").alias("w"))
    effects = {"nowruz_window": "nowruz", "official_holiday": "holiday", "wet_weather": "wet_weather"}
    value = "adjusted_index_difference_points" if "adjusted_index_difference_points" in sets["context_effects"].columns else "mean_difference"
    name = "context_factor" if "context_factor" in sets["context_effects"].columns else "factor"
    side = sides.groupBy("approach").agg(F.avg(VALUE).alias("v"))
    focus = F.col("site") == p.focus_site
    at = lambda d, by, as_: placed(d.where(F.col(by).isNotNull()), by).agg(F.max(F.when(focus, F.col("place"))).alias(as_), F.count("*").alias(f"{as_}_of"))
    more = [
        sets["shock_recovery"].agg(F.corr("shock_change", "recovery_change").alias("shock_recovery_correlation")), ranks.agg(F.corr("v", "w").alias("volume_centrality_spearman")), peak_cell(sets["hour_week_heatmap"]),
        sets["context_effects"].agg(*[F.max(F.when(F.col(name) == k, F.col(value))).alias(f"{v}_difference") for k, v in effects.items()]), at(nodes, VALUE, "focus_volume_place"), at(nodes, "weighted_degree", "focus_link_place"),
        side.agg(F.max_by("approach", F.struct("v", "approach")).alias("focus_dominant_approach"), (F.sum(F.when(F.col("approach").isin("North", "South"), F.col("v"))) / F.sum("v")).alias("focus_corridor_share")),
    ]
    for m in more:
        out = out.join(m)  # one row each
    return out


def run_summary(x: Inputs, settings: Settings = Settings()) -> DataFrame:
    """One row about a run: its window, sites and readings, readings that are invalid (of all and of operational channels),
    the months without sources, peak and low month, the largest falls and rises of paired months, the most linked site."""
    panel = panels.trusted(x.monthly, settings.trusted_temporal_coverage, settings.trusted_detector_coverage)
    paired, season = changes.summarized(changes.adjacent(panel)), panels.month_of_year(panels.common(panel, settings.baseline_year))
    ok = F.col("operational") if "operational" in x.channels.columns else F.lit(True)
    low, high = (lambda c, k: F.min_by(k, F.struct(c, k))), (lambda c, k: F.min_by(k, F.struct(-F.col(c), F.col(k))))
    parts = [
        x.monthly.agg(F.min("year_month").alias("first_month"), F.max("year_month").alias("last_month"), F.count_distinct("site").alias("sites"), F.count("*").alias("site_months")), panel.agg(F.count("*").alias("trusted_site_months")),
        x.channels.agg(F.sum("observations").alias("readings"), F.sum("invalid").alias("invalid_readings"), (F.sum("invalid") / F.sum("observations")).alias("invalid_rate"), (F.sum(F.when(ok, F.col("invalid"))) / F.sum(F.when(ok, F.col("observations")))).alias("operational_invalid_rate")),
        x.sources.agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "Missing", F.col("year_month")))), ", ").alias("missing_source_months")),
        season.agg(high("month_median", "month").alias("peak_month"), low("month_median", "month").alias("low_month"), (F.max("month_median") / F.min("month_median") - 1).alias("peak_to_trough"), F.count("*").alias("panel_months")),
        paired.agg(low("median_change", "year_month").alias("largest_fall_month"), F.min("median_change").alias("largest_fall"), high("median_change", "year_month").alias("largest_rise_month"), F.max("median_change").alias("largest_rise")),
        x.nodes.agg(F.max_by("site", F.when(F.col("weighted_degree").isNotNull(), F.struct("weighted_degree", -F.col("site")))).alias("most_linked_site"), F.count("*").alias("graph_nodes")), x.edges.agg(F.count("*").alias("graph_edges")),
    ]
    out = parts[0]
    for m in parts[1:]:
        out = out.join(m)  # one row each
    return out


#: The explorer's sections and the charts in each.
SECTIONS = {"city": ("monthly", "changes"), "patterns": ("weekly", "seasonality"), "sites": ("shock_recovery", "approaches", "groups"), "quality": ("coverage",)}


def explorer(sets: Mapping[str, DataFrame], only: str | None = None) -> DataFrame:
    """The explorer's eight charts (or one of them) in long form: (section, chart, trace, x, y, label), x as text.

    Series by month are on the spine of source months, so that a month without data is a row without a value and no line
    bridges it. Months that are partly there give no value to a line either: they are traces of their own.
    """
    spine = sets["source_quality"].select("year_month", "status", "coverage" if "coverage" in sets["source_quality"].columns else F.lit(None).cast("double").alias("coverage"))
    whole, part = F.col("status") == "Complete", F.col("status") == "Partial"
    section = {c: s for s, charts in SECTIONS.items() for c in charts}

    def chart(name: str, df: DataFrame, trace, x, y, label=None) -> DataFrame:
        as_text = lambda c: (F.lit(None) if c is None else c).cast("string")
        return df.select(F.lit(section[name]).alias("section"), F.lit(name).alias("chart"), as_text(trace).alias("trace"), as_text(x).alias("x"), y.cast("double").alias("y"), as_text(label).alias("label"))

    at, one = F.concat("year_month", F.lit("-01")), F.lit("all")
    by_month = lambda name, *columns: spine.join(sets[name].select("year_month", *columns), "year_month", "left")

    def weekly() -> list[DataFrame]:
        cells = sets["hour_week_heatmap"].select("weekday_name", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"h{h:02d}").alias("v")) for h in range(24)])).alias("c"))
        return [chart("weekly", cells, F.col("weekday_name"), F.col("c.h"), F.col("c.v"))]

    def approaches() -> list[DataFrame]:
        sides = by_month("site_approaches", "approach", VALUE, F.col("coverage").alias("detectors"))
        names = sets["site_approaches"].select("approach").distinct()
        every = spine.select("year_month", "status").join(names).join(sides.select("year_month", "approach", VALUE), ["year_month", "approach"], "left")  # months and four sides
        return [chart("approaches", every, F.col("approach"), at, F.when(whole, F.col(VALUE))), chart("approaches", every.where(part), F.concat("approach", F.lit(" (partial)")), at, F.col(VALUE))]

    charts = {
        "monthly": lambda: [chart("monthly", by_month("city_monthly", "median_volume", "sites"), one, at, F.when(whole, F.col("median_volume")), F.col("sites"))],
        "changes": lambda: [chart("changes", by_month("paired_changes", "median_change", "period_label"), one, at, F.col("median_change"), F.col("period_label"))],
        "weekly": weekly,
        "seasonality": lambda: [chart("seasonality", sets["seasonality"], one, F.col("month_name"), F.col("month_median"), F.col("common_panel_sites"))],
        "shock_recovery": lambda: [chart("shock_recovery", sets["shock_recovery"], F.col("site"), F.col("shock_change"), F.col("recovery_change"), F.col("label"))],
        "approaches": approaches,
        "groups": lambda: [chart("groups", sets["community_nodes"], F.col("site"), F.col(VALUE), F.col("weighted_degree"), F.col("label"))],
        "coverage": lambda: [chart("coverage", spine, F.col("status"), at, F.coalesce("coverage", F.lit(0.0)))],
    }
    return reduce(DataFrame.unionByName, [d for name, made in charts.items() if only in (None, name) for d in made()])


def explorer_payload(sets: Mapping[str, DataFrame], most: int = 20_000) -> str:
    """The explorer as one JSON text: sections, charts by trace in order of x, and the sizes of the result sets."""
    rows = explorer(sets).orderBy("chart", "trace", F.col("x").try_cast("double"), "x").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} points")
    charts: dict = {c: {"section": s, "traces": {}} for s, names in SECTIONS.items() for c in names}
    for r in rows:
        t = charts[r.chart]["traces"].setdefault(r.trace, {"x": [], "y": [], "label": []})
        for k in t:
            t[k].append(r[k])
    out = {"sections": [{"id": s, "charts": list(c)} for s, c in SECTIONS.items()], "charts": charts, "datasets": [{"id": n, "count": d.count()} for n, d in sets.items()]}
    return json.dumps(out, ensure_ascii=False, allow_nan=False).replace("<", "\\u003c")


def checks(x: Inputs, settings: Settings = Settings(), p: Periods = Periods(), least: tuple[int, int, int] = (30, 30, 25)) -> DataFrame:
    """One row: repeated keys, pairs of each named change, and `passed`, which needs no repeats and `least` pairs of each."""
    panel = panels.trusted(x.monthly, settings.trusted_temporal_coverage, settings.trusted_detector_coverage)
    repeated = [quality.duplicates(d, *k).withColumnRenamed("duplicate_keys", n) for d, k, n in ((x.monthly, ("year_month", "site"), "monthly_repeats"), (x.days, ("date",), "day_repeats"), (x.nodes, ("site",), "node_repeats"))]
    names = ("shock_change", "recovery_change", "latest_change")
    one = site_changes(panel, p).agg(*[F.count(c).alias(f"{c}_sites") for c in names], F.count_if(F.col("regime") == "Review").alias("review_sites"))
    for r in repeated:
        one = one.join(r)  # one row each
    ok = (F.col("monthly_repeats") == 0) & (F.col("day_repeats") == 0) & (F.col("node_repeats") == 0)
    for c, n in zip(names, least, strict=True):
        ok = ok & (F.col(f"{c}_sites") >= n)
    return one.withColumn("passed", ok)


def artifact(sets: Mapping[str, DataFrame], most: int = 20_000) -> str:
    """The result sets as one JSON text, for a page: rows by name. Each set is checked to be small (`most` rows)."""
    out = {}
    for name, df in sets.items():
        rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name}: over {most} rows")
        out[name] = [json.loads(r.r) for r in rows]
    return json.dumps({"datasets": out}, ensure_ascii=False, allow_nan=False).replace("<", "\\u003c")
