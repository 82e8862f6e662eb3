"""Thresholds and named periods, as parameters of every operator that needs them."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Periods:
    # The months and ranges (ends included) that published results compare.
    shock: tuple[str, str] = ("2020-02", "2020-03")
    recovery: tuple[str, str] = ("2020-04", "2020-05")
    latest: tuple[str, str] = ("2020-01", "2021-01")
    before: tuple[str, str] = ("2019-01", "2020-02")
    after: tuple[str, str] = ("2020-03", "2020-10")
    heatmap_end: str = "2020-10"
    unadjusted_factor: str = "friday_weekend"
    focus_site: int = 1081


@dataclass(frozen=True)
class Settings:
    # Defaults that published results depend on.
    minimum_detector_coverage: float = 0.5
    trusted_temporal_coverage: float = 0.8
    trusted_detector_coverage: float = 0.8
    graph_neighbors: int = 4
    graph_minimum_correlation: float = 0.55
    operational_readings: int = 100
    dtw_window: int = 3
    baseline_year: int = 2019
    sentinels: tuple[int, ...] = (2046, 2047)
    ramadan_windows: tuple[tuple[str, str], ...] = ()
    context_start: str = "2018-10-01"
    context_end: str = "2021-01-31"
    policy_country: str = "IRN"
    geocode_place: str = "اصفهان, ایران"
    geocode_bbox: tuple[float, float, float, float] = (32.55, 51.55, 32.80, 51.85)
    street_prefixes: tuple[str, ...] = ("چهارراه", "چهار راه", "سه راه", "میدان", "شمال پل", "جنوب پل", "شمال", "جنوب")

    @staticmethod
    def load(path: str) -> Settings:
        """Settings from a JSON file; keys that are not ours are ignored, missing ones keep their default."""
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        known = {x.name for x in fields(Settings)}
        return Settings(**{k: tuple(map(tuple, v)) if k == "ramadan_windows" else tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in known})
