"""The pipeline over odd rows: nulls, repeats, long texts, columns with clashing names, and no rows at all."""

import random

import corpus_pipeline
from flowtally.llm import common, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, part int, uid string, base string, copy int, h int"


def test_odd_rows(spark, tmp_path):
    r = random.Random(21)
    known = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)] + "the of and to in is it".split() * 20
    text = lambda n: ". ".join(" ".join(r.choice(known) for _ in range(8)) for _ in range(n)) + "."
    more = ("kept", "k", 3, "u", "b", 9, 1)
    rows = [(i, t, None if i % 5 else "en", f"s{i % 3}" if i % 4 else None, len(t), *more) for i, t in ((i, text(12)) for i in range(40))]
    rows += [rows[2], rows[2], (None, rows[3][1], *rows[3][2:]), (None, text(12), *rows[3][2:]), (50, None, "en", "s1", None, *more), (51, "", "en", "s1", 0, *more), (None, None, None, None, None, *[None] * 7), (52, text(4000), "en", "s2", 1, *more)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(rows[7][1].split()[4:18])), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, got = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = common.write_table(stage(spark, docs, str(tmp_path)), "test")
        got[name] = docs.collect()
        assert docs.columns == names or name == "mixing sources"
        if name != "mixing sources":
            assert all(x.size == "kept" and x.key == "k" and x.uid == "u" and x.base == "b" and x["copy"] == 9 for x in got[name])
    ids = [sorted(str(x.doc_id) for x in got[name]) for name, _ in corpus_pipeline.STAGES]
    assert ids[0] == sorted([*map(str, range(40)), "2", "2", "None", "None", "52"])  # rows without a word are junk
    assert ids[1] == sorted([*map(str, range(40)), "None", "None", "52"])  # of a repeated row one stays, rows without an id stay
    assert ids[2] == ids[3] == sorted(x for x in ids[1] if x != "7")
    assert [x.text for x in got["PII"] if x.doc_id == 52] == [rows[-1][1]]
    assert all(x["copy"] <= x.copies <= 2 for x in got["mixing sources"]) and len({x.doc_id for x in got["mixing sources"]}) > 25


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_of_stages_are_small(spark, tmp_path, monkeypatch):
    """Stages send texts to Python by a thousand at most, and the session's own bound is back afterwards."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.range(2500).selectExpr("id AS doc_id", "'x' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(spark, docs, sf_dir):
        return docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes), ("as it is", lambda spark, docs, sf_dir: docs)])
    got = [r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(got) == 2500 and max(got) <= 1000 and spark.conf.get(key) == before


def test_gathered_features_are_copied_once():
    """What the driver fits on takes eight bytes an entry beside the rows it got, in the order of their hashes."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from flowtally.llm import quality

    r = np.random.default_rng(2)
    n = 40_000
    many = lambda kind: [r.integers(0, 9, n).astype(kind).tobytes() for _ in range(50)]
    h = r.permutation(50)
    rows = pa.concat_tables([pa.table({"h": h[a:b], "k": h[a:b] + 1, "code": h[a:b] * 3, "i": pa.array(i, pa.binary()), "v": pa.array(v, pa.binary())}) for a, b, i, v in [(0, 20, many(np.int32)[:20], many(np.float32)[:20]), (20, 50, many(np.int32)[:30], many(np.float32)[:30])]])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    index, value, per, code, times = quality._in_order(rows)
    peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert peak < 1.1 * 8 * 50 * n
    s = rows.sort_by("h")
    assert (index == np.frombuffer(b"".join(s["i"].to_pylist()), np.int32)).all() and (value == np.frombuffer(b"".join(s["v"].to_pylist()), np.float32)).all()
    assert (per == n).all() and code.tolist() == list(range(0, 150, 3)) and times.tolist() == list(range(1, 51))


def test_the_fit_comes_by_partitions(spark, monkeypatch):
    """The sample for the quality scorer doesn't pass the driver's JVM as one result, and the model is that of the sample in one piece."""
    d = spark.createDataFrame([(f"the word {k} of it is {'good. ' * (k % 7)}{'#$% ' * (k % 3)}",) for k in range(300)], "text string").repartition(5)
    kind, seen = type(d), []
    monkeypatch.setattr(kind, "toArrow", lambda self, f=kind.toArrow: seen.append(self.columns) or f(self))
    model = quality.fit(d)
    assert seen == [["code", "n"]]
    monkeypatch.setattr(common, "fetched", lambda df, schema: df.toArrow().cast(schema))
    whole = quality.fit(d)
    assert model.bias == whole.bias and (model.weights == whole.weights).all() and model.weights.any()
    assert quality.fit(d.limit(0)).bias == 0.0


def test_the_heap_is_given_back():
    """The driver's garbage is collected only once the heap is more than half of what it may be."""
    from types import SimpleNamespace as Of

    calls = []
    for total in (40, 50, 51, 100):
        heap = Of(totalMemory=lambda total=total: total, maxMemory=lambda: 100)
        common.give_back(Of(sparkContext=Of(_jvm=Of(java=Of(lang=Of(Runtime=Of(getRuntime=lambda heap=heap: heap), System=Of(gc=lambda total=total: calls.append(total))))))))
    assert calls == [51, 100]


def test_stages_on_their_own_send_small_batches(spark, tmp_path, monkeypatch):
    """A stage sends texts to Python by a thousand at most also where run() doesn't call it, and what it returns needs no Python any more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    docs = spark.createDataFrame([(k, f"the word {k % 9} of it is {'good. ' * (k % 7)}", "en", "s", 9) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "of it is good")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(common, "write_table", lambda df, *a, f=common.write_table: seen.append(int(spark.conf.get(key))) or f(df, *a))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name not in ("PII", "mixing sources"):
            assert seen and max(seen) <= 1000, name
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan, name
        assert spark.conf.get(key) == before
        seen.clear()
