"""Nearest profiles by tiles: the edges of all pairs, from fewer pairs of tiles."""

import math
from datetime import datetime

import numpy as np
import pytest

from flowtally.operators import blocks, graph, shape, tiles
from flowtally.plans import catalogue


def standard(x):
    return (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)


def table(spark, z):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "site long, z array<double>").repartition(4)


def brute(z, k, minimum):
    c = np.einsum("ik,jk->ij", z, z, optimize=False) / z.shape[1]
    edges = {}
    for i in range(len(z)):
        near = sorted(((c[i, j], j) for j in range(len(z)) if j != i and c[i, j] >= minimum), reverse=True)[:k]
        edges |= {(min(i, j), max(i, j)): r for r, j in near}
    return edges


@pytest.mark.parametrize("kind, minimum", [("groups", 0.55), ("noise", 0.05), ("copies", 0.2), ("few", 0.0)])
def test_edges(spark, monkeypatch, kind, minimum):
    monkeypatch.setattr(tiles, "ROWS", 16)
    monkeypatch.setattr(tiles.Tiles.__init__, "__defaults__", (8, 16))
    r = np.random.default_rng(3)
    x = {"groups": lambda: r.normal(size=(6, 24))[r.integers(0, 6, 240)] + r.normal(scale=0.15, size=(240, 24)), "noise": lambda: r.normal(size=(150, 24)), "copies": lambda: np.concatenate([np.tile(r.normal(size=(1, 24)), (80, 1)), r.normal(size=(60, 24))]), "few": lambda: r.normal(size=(3, 24))}[kind]()
    z = standard(x)
    d = table(spark, z)
    got = {(e.src, e.dst): e.weight for e in graph.neighbour_edges(d, 4, minimum).collect()}
    want = brute(z, 4, minimum)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    t = graph.tiled(d, 4, minimum)
    n, held = t.tiles.count(), t.pairs().count()
    assert t.tiles.selectExpr("max(size(sites)) AS m").first().m <= 16
    if kind == "groups":
        assert held < 0.45 * n * (n + 1) / 2, (held, n)


def test_edges_of_nothing(spark):
    assert graph.neighbour_edges(spark.createDataFrame([], "site long, z array<double>")).count() == 0
    zero = spark.createDataFrame([(1, [0.0] * 4), (2, [0.0] * 4), (3, [1.0, -1.0, 1.0, -1.0])], "site long, z array<double>")
    assert graph.neighbour_edges(zero, 2, 0.1).count() == 0


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 10)
    z = standard(np.random.default_rng(1).normal(size=(90, 12)))
    sizes = []

    def look(s, x, t, y, same):
        return {"n": np.array([max(len(s), len(t))])}

    sizes = [r.n for r in blocks.by_blocks(table(spark, z), look, "n long").collect()]
    assert max(sizes) <= 30 and len(sizes) >= 40
    assert graph.correlations(table(spark, z)).count() == 90 * 89 // 2


def test_eigenvector_in_rounds(spark, monkeypatch):
    """The rounds on the cluster end where those on the driver do; a hub, a site without edges, two parts."""
    r = np.random.default_rng(5)
    pairs = {(0, k) for k in range(1, 25)} | {tuple(sorted(p)) for p in r.integers(0, 25, (40, 2)).tolist() if p[0] != p[1]} | {(30, 31), (31, 32)}
    e = spark.createDataFrame([(a, b, float(r.uniform(0.2, 1)), 1.0) for a, b in sorted(pairs)], "src long, dst long, weight double, distance double").repartition(3)
    n = spark.createDataFrame([(k,) for k in [*range(25), 30, 31, 32, 40]], "site long")
    want = {x.site: x.eigenvector for x in graph.eigenvector(n, e).collect()}
    got = {x.site: x.eigenvector for x in graph.eigenvector_in_rounds(n, e).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9 and want[0] > want[1]
    assert {x.eigenvector for x in graph.eigenvector_in_rounds(n, e, rounds=1).collect()} == {None}
    assert graph.eigenvector_in_rounds(n.limit(0), e.limit(0)).count() == 0
    monkeypatch.setattr(graph, "MOST_NODES", 3)
    large = {x.site: x.eigenvector for x in graph.eigenvector(n, e).collect()}
    assert large.keys() == want.keys() and max(abs(large[k] - want[k]) for k in large) < 1e-9


def test_tiles_are_sent_by_groups(spark, monkeypatch):
    """A tile is sent once for each group of tiles, not once for each tile that it is compared with."""
    monkeypatch.setattr(tiles.Tiles.__init__, "__defaults__", (8, 16))
    t = graph.tiled(table(spark, standard(np.random.default_rng(4).normal(size=(600, 24)))), 4, 0.05)
    calls = t.looked(lambda of, pairs: {"sent": np.array([len(of)]), "pairs": np.array([len(pairs)])}, "sent long, pairs long").collect()
    assert sum(c.pairs for c in calls) == t.pairs().count() > 4 * sum(c.sent for c in calls)


def test_communities_of_large_graphs(spark, monkeypatch):
    """A graph that the driver doesn't take is merged by components, with the same communities."""
    r = np.random.default_rng(9)
    pairs = {tuple(sorted(p)) for k in range(4) for p in (r.integers(0, 20, (45, 2)) + 20 * k).tolist() if p[0] != p[1]}
    e = spark.createDataFrame([(a, b, float(w), 1.0) for (a, b), w in zip(sorted(pairs), r.uniform(0.2, 1, len(pairs)), strict=True)], "src long, dst long, weight double, distance double").repartition(3)
    n = spark.createDataFrame([(k,) for k in range(85)], "site long")
    for term in ("unit", "weight"):
        want = {x.site: x.community for x in graph.communities(n, e, term).collect()}
        with monkeypatch.context() as small:
            small.setattr(graph, "MOST_NODES", 3)
            assert {x.site: x.community for x in graph.communities(n, e, term).collect()} == want and len(want) == 85


def test_clusters_of_many_sites(spark, monkeypatch):
    """More sites than the driver takes are merged in rounds, with the clusters and the silhouette of the driver: groups, copies, and
    two far ones that merge early and yet are a cluster of their own."""
    r = np.random.default_rng(11)
    for kind in (1, 2):
        x = r.normal(size=(4, 8))[r.integers(0, 4, 60)] * 2 + r.normal(scale=0.3, size=(60, 8))
        x = np.concatenate([x, np.tile(x[:1], (25, 1)), np.full((1, 8), 30.0), np.full((1, 8), 30.5)])
        x = x if kind == 1 else np.concatenate([x, r.normal(size=(60, 8)), np.array([[9.0] * 4 + [-9.0] * 4])])
        d = table(spark, x)
        want = {e.site: (e.cluster, e.silhouette) for e in shape.clusters(d).collect()}
        with monkeypatch.context() as small:
            small.setattr(shape, "MOST_SITES", 30)
            small.setattr(blocks, "ROWS", 40)
            got = {e.site: (e.cluster, e.silhouette) for e in shape.clusters(d).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    monkeypatch.setattr(shape, "MOST_SITES", 3)
    same = table(spark, np.ones((5, 8)))
    assert {(e.site, e.cluster, e.silhouette) for e in shape.clusters(same).collect()} == {(k, 1 + (k == 4), 0.0) for k in range(5)}
    two = table(spark, np.array([[0.0] * 8] * 4 + [[1.0] * 8] * 3))
    assert {(e.site, e.cluster, e.silhouette) for e in shape.clusters(two).collect()} == {(k, 1 + (k > 3), 1.0) for k in range(7)}


def test_blocks_go_through_one_shuffle(spark, monkeypatch):
    """Rows are sent once for each block, in one shuffle, whatever is looked at together; a site's rows stay together."""
    monkeypatch.setattr(blocks, "ROWS", 10)
    sites = [5] * 25 + list(range(10, 75))
    z = spark.createDataFrame([(k, [float(i), 1.0]) for i, k in enumerate(sites)], "site long, z array<double>").repartition(5)

    def look(s, x, t, y, same):
        return {"a": [s.tolist()], "b": [t.tolist()], "pairs": [sum(p != q for p in x[:, 0] for q in y[:, 0]) // (1 + same)]}

    d = blocks.by_blocks(z, look, "a array<long>, b array<long>, pairs long")
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = d.collect()
    assert sum(r.pairs for r in got) == 90 * 89 // 2
    for x in (r[c] for r in got for c in ("a", "b")):
        assert len(x) <= 10 and 5 not in x or x.count(5) == 25


def test_shapes_of_equal_readings_are_equal(spark, tmp_path):
    """Whatever order its readings come in, a user has the same shape, to the last bit, so that copies are one from the start."""
    r = np.random.default_rng(13)
    hours, v = np.repeat(np.arange(24), 30), np.concatenate([r.lognormal(3, 2, 700), [1e9 + 0.1, 3e13, -0.7, 0.1, 0.2, 0.3] * 3, [1e-9, 0.0]])
    rows = [(u, datetime(2024, 1, 1 + int(i) % 28, int(hours[i])), float(v[i])) for u in range(6) for i in (r.permutation(720) if u else range(720))]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    z = [e.z for e in catalogue.hour_shapes(spark, str(tmp_path)).collect()]
    assert len(z) == 6 and all(x == z[0] for x in z)
    m = np.array([math.fsum(v[hours == h]) / 30 for h in range(24)])
    assert np.allclose(z[0], (m - m.mean()) / m.std(), rtol=1e-12, atol=1e-12)


def test_warping_all_pairs():
    """All rows of two blocks at once cost what they cost one to one, whatever is warped together."""
    r = np.random.default_rng(12)
    x, y = r.normal(size=(37, 24)), r.normal(size=(53, 24))
    i, j = np.divmod(np.arange(37 * 53), 53)
    assert (shape.every(x, y, 3).ravel() == shape.warped(x[i], y[j], 3)).all()
    assert (shape.every(x, x, 3, same=True) == np.triu(shape.every(x, x, 3), 1)).all()


def test_shuffles_go_with_their_checkpoint(spark):
    """What was shuffled for a checkpointed table doesn't stay on the disk of executors."""
    from flowtally.session import lineage_cut

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: {f for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = held()
    d = lineage_cut(spark.range(1000).groupBy("id").count())
    assert not [f for f in held() - before if f.endswith(".data")] and d.count() == 1000


def test_standardized_profiles(spark):
    """Gaps take the site's median; short and level sites go, whatever a mean's rounding."""
    rows = [(1, 0, 1.0), (1, 1, 4.0), (1, 3, 2.0), (1, 2, None), (2, 0, 5.0), (3, 0, 0.1), (3, 1, 0.1), (3, 2, 0.1), (3, 3, 0.1)]
    d = spark.createDataFrame(rows, "site long, bin int, value double").repartition(3)
    x = np.array([1.0, 4.0, 2.0, 2.0])
    got = {r.site: r.z for r in graph.standardized(d, 3).collect()}
    assert got.keys() == {1} and np.allclose(got[1], (x - x.mean()) / x.std(), atol=1e-14)
    assert {r.site: r.z for r in graph.standardized(d, 3, constant=True).collect()}[3] == [0.0] * 4
    assert graph.standardized(d.limit(0), 3).count() == 0


def between(sites, edges):
    """Betweenness from all shortest paths between two sites, listed one by one."""
    near = {s: {} for s in sites}
    for a, b, _, x in edges:
        near[a][b] = near[b][a] = x
    total = dict.fromkeys(sites, 0.0)
    for s in sites:
        best, paths, todo = {s: 0.0}, {s: [[s]]}, [[s]]
        while todo:
            p = todo.pop()
            for v, x in near[p[-1]].items():
                d = sum(near[a][b] for a, b in zip(p, p[1:], strict=False)) + x
                if v not in p and d <= best.get(v, d):
                    paths[v] = [q for q in paths.get(v, []) if d == best[v]] + [[*p, v]]
                    best[v] = d
                    todo.append([*p, v])
        for t, all_of in paths.items():
            mine = {tuple(q) for q in all_of if sum(near[a][b] for a, b in zip(q, q[1:], strict=False)) == best[t]}
            for q in mine:
                for v in q[1:-1]:
                    total[v] += 1 / len(mine)
    k = len(sites)
    return {v: x / ((k - 1) * (k - 2)) for v, x in total.items()}


def test_betweenness_of_large_graphs(spark, monkeypatch):
    """Graphs that the driver doesn't take are not refused: packed for the tasks, or in rounds on the cluster. Ties, a hub, a site
    without edges, two parts."""
    r = np.random.default_rng(13)
    pairs = {(0, k) for k in range(1, 9)} | {tuple(sorted(p)) for p in r.integers(0, 14, (16, 2)).tolist() if p[0] != p[1]} | {(20, 21), (21, 22)}
    sites = [*range(14), 20, 21, 22, 30]
    n = spark.createDataFrame([(k,) for k in sites], "site long")
    kind = "src long, dst long, weight double, distance double"
    monkeypatch.setattr(graph, "MOST_NODES", 3)
    for step in (1, 64):
        rows = [(a, b, 1.0, int(x) / step) for (a, b), x in zip(sorted(pairs), r.integers(1, 3 if step == 1 else 200, len(pairs)), strict=True)]
        e, want = spark.createDataFrame(rows, kind).repartition(3), between(sites, rows)
        got = {x.site: x.betweenness for x in graph.betweenness(n, e).collect()}
        assert got == pytest.approx(want, abs=1e-12) and want[0] > 0 == want[30]
    with monkeypatch.context() as small:
        small.setattr(graph, "HELD_NODES", 3)
        assert {x.site: x.betweenness for x in graph.betweenness(n, e).collect()} == pytest.approx(want, abs=1e-12)
    assert {x.site: x.betweenness for x in graph.betweenness_in_rounds(n, spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.0)], kind), rows=100).collect()}[1] == pytest.approx(2 / (17 * 16))
    assert [x.betweenness for x in graph.betweenness(n, e.limit(0)).collect()] == [0.0] * 18 and graph.betweenness(n.limit(0), e.limit(0)).count() == 0
