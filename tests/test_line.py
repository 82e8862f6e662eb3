"""Windows over the whole table, as-of joins, interval joins, quantiles and grids against brute force; small blocks, ties, hot keys."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.functions import scalars as S
from flowtally.operators import asof, changes, context, detectors, intervals, quality, quantiles
from flowtally.operators.line import Line, numbered
from flowtally.plans import datasets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, 1, 2, 3]) if i % 3 else 7, r.random()) for i in range(500)]
    return rows, spark.createDataFrame(rows, "k long, v int, w double").repartition(6, "w")


def test_numbers_are_dense(values):
    rows, df = values
    d, total = numbered(df, [F.col("v").desc_nulls_last(), F.col("k")])
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert total == 500 and [(r.k, r.n) for r in d.orderBy("n").collect()] == [(r[0], i) for i, r in enumerate(want, 1)]


@pytest.mark.parametrize("block", [3, 7, 64, 1000])
def test_line(values, block):
    rows, df = values
    line = Line(df, [F.col("k")], block)
    got = line.with_near(2, 1, {"near": lambda w: F.collect_list("k").over(w)}).collect()
    assert {r.k: r.near for r in got} == {k: [x for x in range(k - 2, k + 2) if 0 <= x < 500] for k in range(500)}
    last = {r.k: r for r in line.with_last({"a": F.when(F.col("k") % 50 == 20, F.col("k")), "b": F.col("v")}).collect()}
    back = {r.k: r.a for r in line.with_last({"a": F.when(F.col("k") % 50 == 20, F.col("k"))}, back=True).collect()}
    sums = {r.k: r for r in line.with_sums({"a": F.when(F.col("k") > 30, F.col("v")), "b": F.lit(1)}).collect()}
    seen = total = None
    for k, v, _ in sorted(rows):
        seen = v if v is not None else seen
        total = (total or 0) + v if v is not None and k > 30 else total
        before, after = k - (k - 20) % 50, k + (20 - k) % 50
        assert (last[k].a, last[k].b) == (before if before >= 0 else None, seen)
        assert back[k] == (after if after < 500 else None)
        assert (sums[k].a, sums[k].b) == (total, k + 1)
    assert len(got) == len(last) == 500


def test_line_of_nothing(spark):
    line = Line(spark.createDataFrame([], "k long"), [F.col("k")])
    assert line.with_near(1, 1, {"x": lambda w: F.count("*").over(w)}).count() == line.with_last({"x": F.col("k")}).count() == line.with_sums({"x": F.col("k")}).count() == 0
    with pytest.raises(ValueError):
        Line(spark.range(3), [F.col("id")], 2).with_near(3, 0, {})


def test_ranks(spark, values, monkeypatch):
    from flowtally.operators import line

    monkeypatch.setattr(line, "BLOCK", 16)
    rows, df = values
    got = {r.k: r.place for r in changes.ranked(df, "v", "place", "k").collect()}
    for k, v, _ in rows:
        assert got[k] == (None if v is None else 1 + sum(x[1] is not None and x[1] > v for x in rows))
    placed = datasets.placed(df.withColumnRenamed("k", "site"), "v")
    assert "SinglePartition" not in plan(placed) + plan(changes.ranked(df, "v", "place", "k"))
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r.site: r.place for r in placed.collect()} == {r[0]: i for i, r in enumerate(want, 1)}


def test_daily_series(spark, monkeypatch):
    from flowtally.operators import line

    monkeypatch.setattr(line, "BLOCK", 8)
    import datetime as dt

    r = random.Random(2)
    days = [dt.date(1997, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    city = [(d, None if r.random() < 0.4 else r.randint(1, 9) * 1.0) for d in days]
    t = spark.createDataFrame(city, "date date, value double").repartition(4)
    out = context.daily_index(t, "value", 1997)
    got = out.orderBy("date").collect()
    assert "SinglePartition" not in plan(out) and len(got) == 120
    for i, row in enumerate(got):
        near = [x.day_index for x in got[max(0, i - 6) : i + 1] if x.day_index is not None]
        assert row.rolling_index == (pytest.approx(statistics.median(near)) if len(near) >= 4 else None)
    c = spark.createDataFrame([(d, i * i) for i, d in enumerate(days) if i % 5 == 2], "date date, cases long")
    f = context.filled(t.select("date"), c, "cases")
    assert "SinglePartition" not in plan(f)
    was = None
    for i, row in enumerate(f.orderBy("date").collect()):
        now = (i - (i - 2) % 5) ** 2 if i >= 2 else None
        assert (row.cases, row.available, row.new_cases) == (now, int(i % 5 == 2), 0 if was is None or now is None else now - was)
        was = now


@pytest.mark.parametrize("block", [5, 1000])
def test_nearest(spark, block):
    r = random.Random(3)
    left = [(i, r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(40)]) if i % 9 else 7) for i in range(200)]
    right = [(r.choice(["hot", "hot", "a", None, "c"]), r.choice([None, *range(40)]), j) for j in range(90)]
    a = spark.createDataFrame(left, "i long, key string, t long").withColumn("before", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    b = spark.createDataFrame(right, "key string, t long, j long")
    got = {x.i: x for x in asof.nearest(a, b, ["key"], "t", ["j"], block).collect()}
    assert len(got) == 200
    for i, key, t in left:
        mine = sorted((u, j) for k, u, j in right if k == key and None not in (k, u, t))
        before = max((x for x in mine if x[0] <= t), default=None) if t is not None else None
        after = min((x for x in mine if x[0] >= t), default=None) if t is not None else None
        after = before if before and before[0] == t else after
        assert (got[i].before and tuple(got[i].before), got[i].after and tuple(got[i].after)) == (before, after), (i, key, t)
    assert asof.nearest(a.limit(0), b, ["key"], "t", ["j"]).count() == 0
    assert asof.nearest(a, b.limit(0), ["key"], "t", ["j"]).where("before IS NULL AND after IS NULL").count() == 200


@pytest.mark.parametrize("widths", [(1, 32), (4, 16), (10, 10)])
def test_inside(spark, widths):
    r = random.Random(5)
    points = [(i, r.choice([0, 1]), r.choice([None, 33, *range(-60, 200)])) for i in range(150)]
    spans = [(j, r.choice([0, 1]), a, a + r.choice([-2, 0, 3, 40, 180])) for j, a in enumerate(r.choices(range(-80, 150), k=60))] + [(99, 0, None, 5), (98, 1, 5, None)]
    p, s = spark.createDataFrame(points, "i long, lane int, t long").withColumn("level", F.lit(1)), spark.createDataFrame(spans, "j long, lane int, a long, z long")
    got = sorted((x.i, x.j) for x in intervals.inside(p, s, "t", "a", "z", ["lane"], widths).collect())
    assert got == sorted((i, j) for i, k, t in points for j, m, a, z in spans if k == m and None not in (t, a, z) and a <= t <= z)
    assert intervals.inside(p, s, "t", "a", "z", [], widths).count() == sum(None not in (t, a, z) and a <= t <= z for _, _, t in points for _, _, a, z in spans)


def test_long_spans_cost_cells(spark):
    d = spark.createDataFrame([(10_007, 10_007 + 3652), (5, 5), (5, 4)], "a long, z long").select(F.size(intervals.cells(F.col("a"), F.col("z"))).alias("n"))
    n = [x.n for x in d.collect()]
    assert n[0] <= 3653 / 32 + 2 * 32 and n[1:] == [1, 0]


@pytest.mark.parametrize("kind", ["ties", "powers", "few"])
def test_quantiles(spark, kind):
    r = np.random.default_rng(7)
    n = 40_000
    v = {"uniform": r.random(n), "ties": np.where(r.random(n) < 0.4, 5.0, r.random(n) * 10), "powers": 10.0 ** r.uniform(-200, 200, n), "two": np.where(r.random(n) < 0.5, 1.0, 2.0), "few": r.random(7)}[kind]
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    rows = [(int(i % 3 == 0), None if i % 11 == 5 else float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    got = {x.g: x for x in quantiles.exact(df, ["g"], "x", shares).collect()}
    for g in (0, 1):
        mine = [x for k, x in rows if k == g and x is not None]
        assert got[g].n == len(mine)
        for k, p in shares.items():
            assert got[g][k] == pytest.approx(float(np.quantile(mine, p)), rel=1e-12)
    every = quantiles.exact(df, [], "x", {"m": 0.5}).first()
    assert every.m == pytest.approx(float(np.median([x for _, x in rows if x is not None])), rel=1e-12)
    assert quantiles.exact(df.where("x IS NULL"), ["g"], "x", shares).count() == 0


def test_quantiles_of_one_large_group(spark):
    """Two million values in one group: no task holds more than a few of them."""
    df = spark.range(2_000_000).select(((F.col("id") * 7_368_787) % 10_000_019).cast("double").alias("x"))
    got = quantiles.exact(df, [], "x", {"m": 0.5, "q": 0.9}).first()
    want = df.selectExpr("percentile(x, array(0.5, 0.9)) AS p").first().p
    assert [got.m, got.q] == pytest.approx(want, rel=1e-12) and got.n == 2_000_000


def test_unique_in_the_plan(spark):
    t = spark.createDataFrame([(1, "a", 2), (2, None, 3), (None, "c", 4)], "k int, row string, v int")
    assert sorted(map(str, quality.require_unique(t, "k").collect())) == sorted(map(str, t.collect()))
    assert quality.require_unique(t.select("k"), "k").count() == 3
    again = quality.require_unique(t.union(t.limit(1)), "k")  # no job yet
    with pytest.raises(Exception, match="repeated key"):
        again.count()
    with pytest.raises(Exception, match="repeated key"):
        spark.range(5).join(again.select("v"), F.col("id") == F.col("v")).collect()


def test_grid(spark):
    """Whatever lies within the limit is in one of the cells around, also at the date line and near the poles."""
    r = random.Random(6)
    places = [(r.uniform(-89.9, 89.9), r.uniform(-180, 180)) for _ in range(300)] + [(32.6, 179.999), (89.95, 10.0), (-89.99, -170.0), (0.0, 0.0)]
    rows = []
    for lat, lon in places:
        for _ in range(4):
            a, m = r.uniform(0, 2 * math.pi), r.uniform(0, 1499) / 111_195
            y = min(89.999, max(-89.999, lat + m * math.sin(a)))
            x = lon + m * math.cos(a) / max(1e-9, math.cos(math.radians(lat)))
            rows.append((lat, lon, y, (x + 180) % 360 - 180))
    d = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("m", S.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    d = d.withColumn("near", F.array_contains(S.cells_around(F.col("a"), F.col("b"), 1500.0), S.cell(F.col("c"), F.col("d"), 1500.0)))
    assert d.where("m <= 1500 AND NOT near").count() == 0 and d.where("m <= 1500").count() > 900


def test_street_pairs_by_cells(spark):
    r = random.Random(8)
    c = [(f"q{q}", k, 32.6 + r.uniform(0, 0.08), 51.6 + r.uniform(0, 0.08)) for q in range(6) for k in range(30)]
    w = [(s, f"q{s % 6}", f"q{(s + 1 + s // 6) % 6}") for s in range(12)]
    got = {x.site: x for x in detectors.street_pairs(spark.createDataFrame(w, "site int, a string, b string"), spark.createDataFrame(c, "query string, rank int, lat double, lon double"), 900.0).collect()}

    def metres(p, q):
        a, b, x, y = map(math.radians, (p[2], q[2], p[3], q[3]))
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((y - x) / 2) ** 2))

    for s, a, b in w:
        d, p, q = min((metres(p, q), p, q) for p in c if p[0] == a for q in c if q[0] == b)
        if d > 900:
            assert s not in got
        else:
            assert got[s].distance_m == pytest.approx(d, abs=1e-6) and got[s].lat == pytest.approx((p[2] + q[2]) / 2)
