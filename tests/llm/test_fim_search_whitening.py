"""Fill-in-the-middle, exact search and whitening against brute force, over tables with nulls, odd vectors, ties and repeats."""

import hashlib
import math
import threading
from array import array

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from flowtally.llm import common, fill_in_middle, topk_search, whitening

TEXTS = [None, "", "x", "ab", "aé\U0001f600\n" * 7, "a <P> b", "<S>", "ends in <M", "<<P" * 9, "P>" * 9, "long " * 300_000, " \t\n", "éä" * 50, "line one\nline two\n\nlast", "a,b;c " * 40]


def brute_fim(key, text, cuts, n):
    """cuts: where the first k units end."""
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[: cuts[a]], text[cuts[a] : cuts[b]], text[cuts[b] :]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def fim_rows():
    return [(i, TEXTS[i % len(TEXTS)], "kept", 7) for i in range(150)] + [(None, "no id", "kept", 7), (3, "ab", "kept", 7), (3, "ab", "kept", 7)]


def test_fill_in_middle_rows(spark, fim_rows):
    docs = spark.createDataFrame(fim_rows, "doc_id long, text string, form string, other int").repartition(4)
    got = fill_in_middle.fill_in_middle(docs).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output"}
    want = sorted((str(i), *brute_fim("" if i is None else i, t or "", range(len(t or "") + 1), len(t or ""))) for i, t, _, _ in fim_rows)
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert fill_in_middle.restored_text(r.output, r.form) == (r.text or "")
    assert fill_in_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_fill_in_middle_query(spark, fim_rows, tmp_path):
    """Names, types and digests of the query, and texts of a megabyte and more."""
    spark.createDataFrame([(i, t, i) for i, t, *_ in fim_rows], "doc_id long, text string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    d = fill_in_middle.op11_fill_in_middle(spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in d.schema] == ["doc_id bigint", "n bigint", "form string", "prefix_chars bigint", "middle_chars bigint", "output_sha256 string", "restored_sha256 string"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, *_ in fim_rows:
        t = t or ""
        *head, out = brute_fim("" if i is None else i, t, range(len(t) + 1), len(t))
        want.append((str(i), *head, sha(out), sha(t)))
    assert sorted((str(r[0]), *r[1:]) for r in d.collect()) == sorted(want)


@pytest.mark.parametrize("unit", [fill_in_middle.CODE_POINT, r"\X", r"\w+\W*", r"[^\n]*\n|[^\n]+", r"[a-z]|\s+"])
def test_unit_ends(unit):
    """Runs of units give the places that single matches give."""
    for t in TEXTS:
        assert fill_in_middle.unit_ends(t or "", unit) == array("I", (m.end() for m in regex.finditer(unit, t or "")))


def test_units_of_words(spark):
    t = "one two  three, four\nfive"
    r = fill_in_middle.fill_in_middle(spark.createDataFrame([(k, t) for k in range(40)], "doc_id long, text string"), unit=r"\w+\W*", plain_from=100).collect()
    cuts = [0, 4, 9, 16, 21, 25]
    assert all(x.n == 5 and x.prefix_chars in cuts and x.prefix_chars + x.middle_chars in cuts and fill_in_middle.restored_text(x.output, x.form) == t for x in r)
    assert len({x.prefix_chars for x in r}) > 2


def test_sentinels_that_hide_are_refused():
    for bad in (("aa", "b", "c"), ("", "b", "c"), ("x", "xy", "c"), ("aba", "b<", "c<"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            fill_in_middle.check_sentinels(bad)
    fill_in_middle.check_sentinels(("<|prefix|>", "<|suffix|>", "<|middle|>"))


# --- exact search ----------------------------------------------------------------------------------------------------


def vectors(seed=3, n=450, dims=5):
    """Clusters, a third of equal vectors, ties, nulls, odd values, short and empty vectors, repeated and null ids."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + r.normal(scale=0.05, size=dims)).tolist()) for i in range(n)]
    rows += [(n + i, [0.5] * dims) for i in range(n // 2)]
    rows += [(100, [0.5] * dims), (200, rows[200][1]), (200, rows[200][1]), (None, [0.9] * dims), (None, None), (3000, None), (3100, [0.1, None, 0.2, 0.3, 0.4]), (3200, [float("nan")] * dims), (3300, [float("inf")] + [0.0] * (dims - 1)), (3400, [1.0]), (3500, []), (3600, [-0.0001] * dims)]
    return rows


def brute_search(rows, k, every):
    v = [(i, [math.floor(1024 * float(c)) for c in x]) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a, (i, x) in enumerate(v):
        if i is not None and i % every == 0:
            s = [(-sum(p * q for p, q in zip(x, y)), j is None, j or 0) for b, (j, y) in enumerate(v) if a != b]
            out += [(i, at, None if none else j, -t) for at, (t, none, j) in enumerate(sorted(s)[:k], 1)]
    return sorted(out, key=str)


SCHEMA = "vec_id long, embedding array<double>"


def found(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("tile, queries, part, pivots, k, every", [(1024, 2048, 32, 64, 10, 100), (7, 3, 2, 5, 4, 10), (16, 1000, 1, 1, 10, 10), (16, 2, 3, 64, 900, 100), (5, 4, 4, 64, 3, 1)])
def test_search(spark, monkeypatch, tile, queries, part, pivots, k, every):
    rows = vectors()
    monkeypatch.setattr(topk_search, "TILE", tile), monkeypatch.setattr(topk_search, "QUERIES", queries), monkeypatch.setattr(topk_search, "PART", part)
    t = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("pivot", F.lit("x")).repartition(5)
    assert found(topk_search.nearest(t, k=k, every=every, pivots=pivots)) == brute_search(rows, k, every)


def test_search_prunes(spark, monkeypatch):
    """Far clusters are not looked at: fewer pairs of annuli and groups than all."""
    monkeypatch.setattr(topk_search, "TILE", 32)
    r = np.random.default_rng(1)
    centres = 8 * np.eye(12)
    rows = [(i, (centres[i % 12] + r.normal(scale=0.02, size=12)).tolist()) for i in range(1200)]
    index = topk_search.Index(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 5, 300)
    assert sorted(((x.id, x.rank, x.found, x.score) for x in index.search().collect()), key=str) == brute_search(rows, 5, 300)
    pairs = next(p for p in common._written if "/pairs-" in p)
    assert spark.read.parquet(pairs).count() < index.tiles.count() / 2
    common.drop_written()


def test_search_of_large_numbers(spark):
    """Products beyond a double's integers are exact; what doesn't fit 64 bits is an error."""
    r = np.random.default_rng(2)
    rows = [(i, (r.integers(-(2**29), 2**29, 3) / 1024 + 0.0001).tolist()) for i in range(60)]
    assert found(topk_search.nearest(spark.createDataFrame(rows, SCHEMA), k=7, every=10)) == brute_search(rows, 7, 10)
    with pytest.raises(ValueError, match="64 bits"):
        topk_search.nearest(spark.createDataFrame([(0, [1e30])], SCHEMA))


def test_search_of_little(spark, tmp_path):
    assert found(topk_search.nearest(spark.createDataFrame([], SCHEMA))) == []
    assert found(topk_search.nearest(spark.createDataFrame([(100, [1.0])], SCHEMA))) == []
    assert found(topk_search.nearest(spark.createDataFrame([(100, [1.0]), (1, [2.0])], SCHEMA))) == [(100, 1, 1, 2 << 20)]
    assert found(topk_search.nearest(spark.createDataFrame([(100, []), (1, [])], SCHEMA))) == [(100, 1, 1, 0)]
    spark.createDataFrame([(100, [0.25, 0.5], 1), (7, [0.5, 0.5], 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = topk_search.op12_topk_search(spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in d.schema] == ["query_id bigint", "rank int", "vec_id bigint", "score bigint"]
    assert found(d) == [(100, 1, 7, 256 * 512 + 512 * 512)]


# --- whitening -------------------------------------------------------------------------------------------------------


def brute_whitening(rows, most=16):
    dims = max(len(x) for _, x in rows if x is not None)
    v = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in x] + [1_000_000] * (dims - len(x))) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    fit = sorted({tuple(x) for _, x in v})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    e, c = np.linalg.eigh(centred.T @ centred / n)
    e, c = e[::-1], c[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    dev = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in v]
    w = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in v]) @ c[:, :k] / np.sqrt(e[:k])
    return [i for i, _ in v], n, dev, w, e[:k] / e.sum()


@pytest.mark.parametrize("dims, n, most", [(5, 300, 16), (24, 200, 16), (130, 90, 16), (6, 4, 16), (20, 300, 3)])
def test_whitening(spark, dims, n, most):
    r = np.random.default_rng(dims)
    x = r.normal(size=(n, dims)) * np.linspace(3, 0.5, dims)
    rows = [(i, x[i].tolist()) for i in range(n)] + [(n + i, x[0].tolist()) for i in range(n // 2)]
    rows += [(None, x[1].tolist()), (5, x[1].tolist()), (6, None), (7, [None] * dims), (8, [float("nan")] * dims), (9, [float("-inf")] * dims), (10, x[2].tolist()[:2])]
    t = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("x")).withColumn("n", F.lit("n")).repartition(3)
    got = whitening.whitened(t, most=most).collect()
    ids, n_fit, dev, w, explained = brute_whitening(rows, most)
    assert len(got) == len(ids) * w.shape[1]
    assert {g.n for g in got} == {n_fit}
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-8
    signs = {}
    for k in range(w.shape[1]):
        mine = sorted((str(g.id), g.deviation, g.whitened) for g in got if g.component == k + 1)
        best = None
        for sign in (1, -1):
            want = sorted((str(i), d, sign * y) for i, d, y in zip(ids, dev, w[:, k]))
            assert [m[:2] for m in mine] == [x[:2] for x in want]
            off = max(abs(a[2] - b[2]) for a, b in zip(mine, want))
            best = off if best is None else min(best, off)
        signs[k] = best
        assert best < 1e-6
        share = next(g.explained for g in got if g.component == k + 1)
        assert abs(share - explained[k]) <= 1e-9 * explained[k]


def test_whitening_of_little(spark, tmp_path):
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        d = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
        assert d.columns == names and d.collect() == []
    # One direction alone varies: one component.
    spark.createDataFrame([(k, [k / 4, 1.0, -k / 4], 1) for k in range(20)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = whitening.op13_whitening(spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in d.schema] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    got = d.collect()
    assert len(got) == 20 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert abs(np.mean([r.whitened**2 for r in got]) - 1) < 1e-12


def test_tables_of_other_threads_stay(spark):
    """dropping() deletes what its own thread has written inside, by an error too, and no more."""
    seen, inside, done = {}, threading.Event(), threading.Event()

    def other():
        inside.wait(60)
        seen["other"] = common.write_table(spark.range(3), "other")
        done.set()

    t = threading.Thread(target=other)
    t.start()
    with pytest.raises(KeyError):
        with common.dropping() as kept:
            seen["gone"] = common.write_table(spark.range(3), "gone")
            seen["kept"] = common.write_table(spark.range(4), "kept")
            kept.append(seen["kept"][1])
            inside.set()
            done.wait(60)
            raise KeyError
    t.join()
    assert seen["other"][0].count() == 3 and seen["kept"][0].count() == 4 and seen["gone"][1] not in common._written
    common.drop_written()
