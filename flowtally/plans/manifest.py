"""How the result sets are shown: charts, cards and tables as data, checked against the sets' columns; a view for developers."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from .datasets import Sets

FORM = 1  # of the JSON that is written


@dataclass(frozen=True)
class Chart:
    """A chart of one set: its kind, the columns of its axes and other channels, and those that are said on pointing at a mark. `wide`
    names columns that are read as rows (column name, value)."""

    title: str
    dataset: str
    kind: str
    channels: dict[str, str]
    said: tuple[str, ...] = ()
    wide: tuple[str, ...] = ()
    line_at: float | None = None
    full: bool = False


_HOURS = tuple(f"h{h:02d}" for h in range(24))
_SIDES = tuple(f"{s}_share" for s in ("south", "west", "north", "east"))

CHARTS: dict[str, Chart] = {
    "months": Chart("Typical site by month", "city_monthly", "line", {"x": "month_date", "y": "median_volume"}, ("sites", "p25", "p75", "source_status"), full=True),
    "changes": Chart("Change from month to month, same sites", "paired_changes", "bar", {"x": "month_date", "y": "median_change"}, ("period_label", "paired_sites", "p25_change", "p75_change"), line_at=0),
    "seasons": Chart("Months of the base year, same sites", "seasonality", "bar", {"x": "month_name", "y": "month_median"}, ("month_mean", "month_std", "common_panel_sites")),
    "days": Chart("Index of days", "daily_trend", "line", {"x": "date", "y": "rolling_index"}, ("day_index", "value", "context_note"), line_at=100, full=True),
    "factors": Chart("Days with a factor against others", "context_effects", "row", {"x": "factor_label", "y": "mean_difference"}, line_at=0),
    "fall_and_rise": Chart("Fall and rise of each site", "shock_recovery", "point", {"x": "shock_change", "y": "recovery_change", "color": "community_label", "size": "mean_volume", "label": "label"}, ("trusted_months",)),
    "falls": Chart("Largest falls", "shock_rank", "row", {"x": "label", "y": "shock_change"}),
    "year_on_year": Chart("Largest changes in a year", "latest_extremes", "row", {"x": "label", "y": "latest_change", "color": "direction"}, line_at=0),
    "sites_by_month": Chart("Large sites by month", "month_heatmap", "cell", {"x": "year_month", "y": "site", "color": "index"}),
    "week": Chart("Hours of the week", "hour_week_heatmap", "cell", {"x": "weekday_name"}, wide=_HOURS),
    "sides": Chart("Sides of one site", "site_approaches", "line", {"x": "year_month", "y": "mean_volume", "color": "approach"}, ("coverage", "observations"), full=True),
    "side_shares": Chart("Shares of the sides", "approach_shares", "stack", {"x": "label"}, ("total",), wide=_SIDES),
    "links": Chart("Volume and links", "community_nodes", "point", {"x": "mean_volume", "y": "weighted_degree", "color": "community_label", "size": "trusted_months", "label": "label"}),
    "groups": Chart("Sites by community", "community_summary", "bar", {"x": "community_label", "y": "sites"}, ("median_volume", "most_central")),
    "map": Chart("Places", "map_points", "point", {"x": "lon", "y": "lat", "color": "community_label", "size": "mean_volume", "label": "label"}, ("confidence", "weighted_degree")),
    "sources": Chart("Coverage of the sources", "source_quality", "bar", {"x": "month_date", "y": "coverage"}, ("status", "sites", "records"), full=True),
    "months_a_site": Chart("Trusted months a site", "trusted_months", "histogram", {"x": "trusted_months"}),
}

#: Cards: title and columns of the headline.
CARDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "latest": ("Change in a year", ("latest_change_median", "latest_change_sites")), "shock": ("The fall", ("shock_change_median", "shock_change_sites")), "recovery": ("The rise", ("recovery_change_median", "recovery_change_sites")),
    "days": ("Days seen", ("observed_days", "calendar_days")), "quality": ("Readings that can't be used", ("invalid_rate", "trusted_site_months")), "graph": ("Sites that are alike", ("graph_nodes", "graph_edges", "communities")), "map": ("Sites on the map", ("mapped_sites", "map_coverage")),
}


@dataclass(frozen=True)
class Table:
    title: str
    dataset: str
    columns: tuple[str, ...]
    sort: str
    falling: bool = False


TABLES: dict[str, Table] = {
    "sites": Table("Every site", "site_summary", ("site", "label", "community", "mean_volume", "shock_change", "recovery_change", "latest_change", "after_vs_before", "cv", "max_abs_change", "regime", "weighted_degree", "trusted_months", "volume_rank", "centrality_rank"), "shock_change"),
    "odd_days": Table("Unusual days", "anomaly_dates", ("date", "deviation", "direction", "context_note", "value"), "deviation"),
    "source_months": Table("Months of the sources", "source_quality", ("year_month", "status", "coverage", "timestamps", "expected", "records", "sites"), "year_month"),
}

#: What the short report has of all this.
REPORT = {"charts": ("months", "seasons", "sides"), "tables": ("sites", "odd_days", "source_months"), "sets": ("headline", "city_monthly", "seasonality", "site_approaches", "site_summary", "anomaly_dates", "community_summary", "source_quality")}


def kind_of(name: str, data_type: T.DataType) -> str:
    """temporal, quantitative or nominal, by a column's type; months as text are temporal."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)) or name in ("month_date", "year_month"):
        return "temporal"
    return "quantitative" if isinstance(data_type, T.NumericType) and name not in ("site", "community") else "nominal"


def format_of(name: str, kind: str) -> str | None:
    """percent for changes, rates, shares and coverages, number for other numbers."""
    if kind != "quantitative":
        return None
    return "percent" if name.endswith(("change", "change_median", "rate", "share", "coverage", "vs_before")) else "number"


def label_of(name: str) -> str:
    return name.replace("_", " ").capitalize()


def _column(sets: Mapping[str, DataFrame], dataset: str, name: str) -> dict:
    schema = sets[dataset].schema
    if name not in schema.names:
        raise ValueError(f"{dataset} has no column {name}")
    kind = kind_of(name, schema[name].dataType)
    out = {"field": name, "type": kind, "label": label_of(name), "format": format_of(name, kind)}
    return {k: v for k, v in out.items() if v is not None}


def _present(sets: Mapping[str, DataFrame], dataset: str, names: tuple[str, ...]) -> list[dict]:
    """Columns that inputs may leave out are left out."""
    return [_column(sets, dataset, n) for n in names if n in sets[dataset].columns]


def manifest(sets: Sets) -> dict:
    """Charts, cards and tables with their columns' types, labels and formats. An axis whose column a set hasn't got is an error."""
    charts, tables = [], []
    for name, c in CHARTS.items():
        given = dict(c.channels)
        if c.dataset == "context_effects" and "adjusted_index_difference_points" in sets[c.dataset].columns:
            given["y"] = "adjusted_index_difference_points"
        one = {"id": name, "title": c.title, "dataset": c.dataset, "type": c.kind, "encodings": {k: _column(sets, c.dataset, v) for k, v in given.items()}, "tooltip": _present(sets, c.dataset, c.said), "layout": "full" if c.full else "half"}
        if c.wide:
            one["wide"] = [_column(sets, c.dataset, w) for w in c.wide]
        if c.line_at is not None:
            one["referenceLines"] = [{"axis": "y", "value": c.line_at}]
        charts.append(one)
    cards = [{"id": k, "title": t, "dataset": "headline", "metrics": [_column(sets, "headline", n) for n in names]} for k, (t, names) in CARDS.items()]
    for name, t in TABLES.items():
        tables.append({"id": name, "title": t.title, "dataset": t.dataset, "columns": _present(sets, t.dataset, t.columns), "defaultSort": {"field": t.sort, "direction": "desc" if t.falling else "asc"}})
    used = sorted({x["dataset"] for x in [*charts, *cards, *tables]})
    return {"form": FORM, "charts": charts, "cards": cards, "tables": tables, "datasets": used}


def report_manifest(whole: dict) -> dict:
    """The part of a manifest that the short report shows."""
    return {"form": FORM, "charts": [c for c in whole["charts"] if c["id"] in REPORT["charts"]], "cards": whole["cards"], "tables": [t for t in whole["tables"] if t["id"] in REPORT["tables"]], "datasets": list(REPORT["sets"])}


def profile(sets: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, field, kind, rows, known): for every column of every set how many rows have a value; one pass a set."""
    out = None
    for name, df in sets.items():
        one = df.agg(F.count("*").alias("rows"), *[F.count(f"`{c}`").alias(f"k{i}") for i, c in enumerate(df.columns)])
        each = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(kind_of(c, df.schema[c].dataType)).alias("kind"), F.col(f"k{i}").alias("known")) for i, c in enumerate(df.columns)])
        one = one.select(F.lit(name).alias("dataset"), "rows", F.explode(each).alias("c")).select("dataset", "c.field", "c.kind", "rows", "c.known")
        out = one if out is None else out.unionByName(one)
    return out


def developer_view(sets: Mapping[str, DataFrame], checks: DataFrame, settings: Settings = Settings(), rows: int = 3) -> dict:
    """For developers: the steps and what they read and write, the rules' values, every set's columns, rows and first rows, and the
    checks."""
    steps = [
        ("metadata", ("logs", "workbook", "diagrams", "overrides"), ("channel_quality", "source_files", "sites", "diagrams", "detectors", "inventory")), ("ingest", ("logs", "detectors"), ("fact", "tables/source_quality")), ("follow", ("logs", "detectors", "state"), ("fact", "state")),
        ("analyze", ("fact",), ("tables/site_monthly", "tables/hour_of_week", "tables/graph_nodes", "tables/graph_edges")), ("context", ("weather", "policy", "holidays", "events", "tables/site_daily"), ("tables/daily_context", "tables/city_daily_with_context")), ("report", ("tables",), ("report",)),
    ]
    seen: dict[str, dict] = {n: {"id": n, "fields": [], "count": 0} for n in sets}
    for r in profile(sets).collect():  # a row for each column
        seen[r.dataset]["count"] = r.rows
        seen[r.dataset]["fields"].append({"field": r.field, "type": r.kind, "known": r.known})
    for n, df in sets.items():
        seen[n]["preview"] = [json.loads(r.r) for r in df.limit(rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).collect()]
    rules = [{"name": f.name, "value": getattr(settings, f.name)} for f in fields(settings) if isinstance(getattr(settings, f.name), (int, float))]
    one = json.loads(checks.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).first().r)
    return {"steps": [{"id": s, "inputs": list(i), "outputs": list(o)} for s, i, o in steps], "rules": rules, "datasets": list(seen.values()), "checks": one}


def text(value: dict) -> str:
    """JSON that may stand inside a page."""
    return json.dumps(value, ensure_ascii=False, allow_nan=False, default=str).replace("<", "\\u003c")
