"""Micro-fixtures of the detector-count operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.functions import scalars as S
from flowtally.operators import changes, context, detectors, graph, normalize, quality, shape
from flowtally.sources import records, tables

LOG = """Int 40 9=1
Monday 07 January 2019 06:45
not a heading
Int 233  2=17\t1 = 6   3=2047
   5=NA 4=0  6=na\r
 8=2046 9=31 9=12
Int 234 1=5 11=7
Int 235 nothing

\tMonday 07 January 2019 07:00
Int 233 1=44
end of file, 3=9
"""


def test_parse(spark):
    d = spark.createDataFrame([("a", LOG), ("b", "nothing here"), ("c", None)], "source_file string, value string")
    got = {(r.ts.minute, r.site_id): r.channels for r in records.parse(d).collect()}
    assert got == {(45, 233): {1: 6, 2: 17, 3: None, 4: 0, 5: None, 6: None, 8: None, 9: 12}, (45, 234): {1: 5, 11: 7}, (0, 233): {1: 44}}
    assert [r.source_month for r in records.file_months(records.parse(d)).collect()] == ["2019-01"]


def test_read_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "jan2019.txt").write_text(LOG)
    (tmp_path / "output.txt").write_text(LOG)
    (tmp_path / "notes.txt").write_text(LOG)
    assert records.read(spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize(
    "channels, want",
    [
        ({1: 10, 2: 20, 3: 30, 4: 0}, (60, 1.0, 60.0, 30.0, 30.0, 0.0, None)),
        ({1: 10, 2: None, 3: 30}, (40, 0.5, 80.0, 20.0, 30.0, None, None)),
        ({1: 10}, (10, 0.25, None, 20.0, None, None, None)),
        ({1: None, 2: None, 3: None, 4: None}, (None, 0.0, None, None, None, None, None)),
    ],
)
def test_coverage(spark, channels, want):
    cfg = normalize.channel_map(spark.createDataFrame([(1, 1, "south", "true"), (1, 2, "south", "1"), (1, 3, "west", "TRUE"), (1, 4, "north", "true"), (1, 5, "east", "false")], "site_id int, channel_id int, approach string, operational string"))
    r = normalize.coverage(spark.createDataFrame([(1, channels)], "site_id int, channels map<int,int>"), cfg).first()
    assert (r.volume_observed, r.detector_coverage, r.volume_normalized, r.south_volume, r.west_volume, r.north_volume, r.east_volume) == want
    other = normalize.coverage(spark.createDataFrame([(2, {5: 7, 9: None})], "site_id int, channels map<int,int>"), cfg).first()
    assert (other.volume_normalized, other.south_coverage) == (14.0, None)


def test_calendar_and_events(spark):
    days = context.spine(spark, "2020-03-19", "2020-03-21")
    c = {r.date: r for r in context.calendar(days, spark.createDataFrame([(dt.date(2020, 3, 20),)], "date date")).collect()}
    r = c[dt.date(2020, 3, 20)]
    assert (r.jalali_year, r.jalali_month, r.jalali_day, r.is_nowruz, r.holiday, r.is_friday) == (1399, 1, 1, 1, 1, 1)
    assert [c[k].days_to_holiday for k in sorted(c)] == [1, 0, 1]
    dates = {"2021-03-20": (1399, 12, 30), "2021-03-21": (1400, 1, 1), "2017-03-20": (1395, 12, 30), "1978-09-08": (1357, 6, 17), "1997-03-21": (1376, 1, 1)}
    for g, j in dates.items():
        x = spark.range(1).select(S.jalali(F.lit(g).cast("date")).alias("j")).first().j
        assert (x.year, x.month, x.day) == j
    e = spark.createDataFrame([("t", "n", 1, dt.date(2020, 1, 2), dt.date(2020, 1, 3))], "event_type string, event_name string, confidence int, date_start date, date_end date")
    rows = context.event_days(context.spine(spark, "2020-01-01", "2020-01-04"), e).collect()
    assert len(rows) == 4 and sum(r.event_count for r in rows) == 2
    assert context.spine(spark, "2018-10-01", "2021-01-01", "MONTH").count() == 28


def test_changes(spark):
    p = spark.createDataFrame([(1, "2020-01", 100.0), (2, "2020-01", 200.0), (2, "2020-02", 150.0), (3, "2020-02", 300.0), (2, "2020-04", 10.0)], "site long, year_month string, mean_volume double")
    assert [(r.site, r.change) for r in changes.adjacent(p).collect()] == [(2, -0.25)]
    assert [(r.site, r.change) for r in changes.fixed(p, "2020-01", "2020-02").collect()] == [(2, -0.25)]
    assert [r.change for r in changes.consecutive(p).where("site = 2").orderBy("year_month").collect()] == [None, -0.25, None]


def path_cost(x, y, band):
    """The least cost of a warping path, over all paths by recursion."""
    from functools import lru_cache

    @lru_cache(maxsize=None)
    def best(i, j):
        if i < 0 or j < 0 or abs(i - j) > max(band, abs(len(x) - len(y))):
            return 0.0 if i == j == -1 else np.inf
        return abs(x[i] - y[j]) + min(best(i - 1, j - 1), best(i - 1, j), best(i, j - 1))

    return best(len(x) - 1, len(y) - 1) / (len(x) + len(y))


@pytest.mark.parametrize("n, m, band", [(24, 24, 3), (7, 7, 1), (9, 12, 2), (5, 5, 9), (1, 1, 3)])
def test_warping(n, m, band):
    r = np.random.default_rng(n)
    x, y = r.normal(size=(20, n)), r.normal(size=(20, m))
    assert np.allclose(shape.warped(x, y, band), [path_cost(tuple(a), tuple(b), band) for a, b in zip(x, y)])
    assert not shape.warped(x, x, band).any()


def test_merge_tree():
    """The chain's tree against merging the nearest two of all clusters again and again."""
    r = np.random.default_rng(3)
    x = r.normal(size=(30, 2))
    d = np.abs(x[:, None] - x).sum(2)
    groups = [[i] for i in range(30)]
    tree = shape.merges(d)
    for k in range(29, 1, -1):
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: d[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[j] += groups.pop(i)
        labels = shape.cut(tree, k)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist())}


def test_clusters(spark):
    z = spark.createDataFrame([(i, [float(i // 3), 0.01 * i, 0.0]) for i in range(6)], "site long, z array<double>")
    got = {r.site: r.cluster for r in shape.clusters(z).collect()}
    assert {frozenset(k for k in got if got[k] == c) for c in got.values()} == {frozenset({0, 1, 2}), frozenset({3, 4, 5})}
    assert [(r.site, r.cluster, r.silhouette) for r in shape.clusters(z.limit(1)).collect()] == [(0, 1, None)]
    assert shape.distances(z).count() == 15 and shape.clusters(z.limit(0)).count() == 0


def test_profiles_and_edges(spark):
    """Blocks of sites against one numpy matrix; constant profiles stay as zeros where they are asked for."""
    r = np.random.default_rng(8)
    v = r.normal(size=(60, 12)).round(1)
    v[7], v[8] = v[9], 4.0
    p = spark.createDataFrame([(i, k, None if (i + k) % 11 == 0 and i != 8 else float(x)) for i, row in enumerate(v) for k, x in enumerate(row)], "site long, bin int, value double")
    z = {x.site: x.z for x in graph.standardized(p, 6, constant=True).collect()}
    assert len(z) == 60 and z[8] == [0.0] * 12 and 8 not in {x.site for x in graph.standardized(p, 6).collect()}
    c = {(i, j): float(np.dot(z[i], z[j]) / 12) for i in z for j in z if i != j}
    want = {}
    for i in z:
        for corr, j in sorted(((c[i, j], j) for j in z if j != i and c[i, j] >= 0.2), reverse=True)[:3]:
            want[min(i, j), max(i, j)] = corr
    d = spark.createDataFrame(list(z.items()), "site long, z array<double>")
    got = {(x.src, x.dst): x.weight for x in graph.neighbour_edges(d, 3, 0.2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert {(x.src, x.dst): round(x.corr, 9) for x in graph.correlations(d).collect()} == {k: round(x, 9) for k, x in c.items() if k[0] < k[1]}


def test_graph(spark):
    edges = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    e = spark.createDataFrame([(a, b, 1.0, 1.0) for a, b in edges], "src long, dst long, weight double, distance double")
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "site long")
    b = {r.site: r.betweenness for r in graph.betweenness(n, e).collect()}
    assert b[3] == pytest.approx(6 * 2 / 30) and b[1] == 0 and b[7] == 0
    for term in ("unit", "weight"):
        c = {r.site: r.community for r in graph.communities(n, e, term).collect()}
        assert c == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 3}
    x = {r.site: r.eigenvector for r in graph.eigenvector(n, e).collect()}
    assert x[3] == pytest.approx(x[4], abs=1e-4) and x[3] > x[1] > x[7]
    assert {r.site: r.component for r in graph.connected(n, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7}
    deg = graph.degrees(n, e)
    assert {r.site: r.degree for r in deg.collect()}[3] == 3
    assert [(r.site, r.place) for r in graph.strongest(deg, 3).collect()] == [(3, 1), (4, 2), (1, 3)]
    meta = graph.metadata(n, e, graph.communities(n, e), graph.connected(n, e)).first()
    assert tuple(meta) == (7, 7, 3, 2)
    chain = spark.createDataFrame([(i, i + 1, 1.0, 1.0) for i in range(40)], "src long, dst long, weight double, distance double")
    assert {r.component for r in graph.connected(spark.range(41).withColumnRenamed("id", "site"), chain).collect()} == {0}


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.title(F.lit("hot_day_35c"))) == "Hot Day 35C"
    assert one(S.persian(F.lit(" كيۀ "))) == "کیه"
    assert one(S.street_tokens(F.lit("st. abcd - way ef/xyz"), [r"st\.", "way"])) == ["abcd", "xyz"]
    assert [one(S.reading(F.lit(v))) for v in ("NA", "2046", "0", "12")] == [None, None, 0, 12]
    assert [one(S.approach(F.lit(x), F.lit(y))) for x, y in ((600, 347), (800, 347), (690, 300), (700, 357), (690, 347))] == ["west", "east", "north", "south", "south"]


def test_sources_and_quality(spark):
    d = spark.createDataFrame([('{"h":{"time":["a","b"],"x":[1.5,null]}}',)], "doc string")
    assert [(r.time, r.x) for r in tables.json_columns(d, "doc", "h", ["x"]).collect()] == [("a", 1.5), ("b", None)]
    with pytest.raises(Exception, match="repeated key"):
        quality.require_unique(spark.createDataFrame([(1,), (1,)], "a int"), "a").collect()
    s = detectors.located(spark.createDataFrame([(1,), (2,), (3,)], "site int"), spark.createDataFrame([(1, 1.0, 2.0)], "site int, lat double, lon double"), spark.createDataFrame([(1, 9.0, 9.0), (2, 3.0, 4.0)], "site int, lat double, lon double"))
    assert {r.site: (r.method, r.lat) for r in s.collect()} == {1: ("direct_name", 1.0), 2: ("street_pair", 3.0), 3: ("unmatched", None)}


def test_stream(spark, tmp_path):
    from flowtally.streaming import daily

    t = dt.datetime(2024, 1, 1, 0, 5)
    spark.createDataFrame([(t, 1, 2.0), (t, 1, 3.0), (t + dt.timedelta(minutes=20), 1, 4.0)], "ts timestamp, site long, value double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, site long, value double").parquet(str(tmp_path / "in"))
    q = daily.windows(s).writeStream.format("memory").queryName("flow").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.volume for r in spark.table("flow").collect()) == [4.0, 5.0]
