"""Exact top-k search by inner product with a pivot-distance index.

Vectors get one more coordinate that brings all to one length M; a query gets 0 there. Then the squared distance of a query
to a vector is |q|^2 + M^2 - 2 (inner product), so the nearest are those with the highest scores, and the triangle inequality
bounds them: a vector at distance r from a pivot is at least |d(q, pivot) - r| from q.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1024
#: Pivots are chosen from a sample of so many rows, each the farthest from those before it.
PIVOTS, SAMPLE = 64, 2048
#: Rows of an annulus at most, queries that are searched together (about), annuli that a task looks at for them (about).
TILE, QUERIES, PART = 1024, 2048, 32
#: Parts into which the annuli of a pivot are dealt where they meet the queries' radii, and a group's queries where they are sent out.
DEALT = 16
#: Scores as high as this aren't exact in a double's products and are multiplied as integers.
EXACT = 1 << 53


def scaled(table: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, x, norm): floor(scale * component) as longs, and the squared length as a double. Vectors that are null or hold null or
    non-finite components are left out."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    v = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", bad))
    x = v.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))
    return x.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of `dims` longs; shorter lists are filled with zeros."""
    flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _unpack(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dims)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that brings them to the squared length `top`."""
    f = x.astype(np.float64)
    return np.concatenate([f, np.sqrt(np.maximum(0, top - (f * f).sum(1)))[:, None]], 1)


def choose_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k different rows, each the farthest from those before it (the first of equals)."""
    out, left = [0], np.full(len(x), np.inf)
    while len(out) < k:
        left = np.minimum(left, ((x - x[out[-1]]) ** 2).sum(1))
        if left.max() <= 0:
            break
        out.append(int(left.argmax()))
    return x[out]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences, as the bounds need small ones to be right."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1)) if len(x) else np.zeros((0, len(pivots)))


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs: as doubles where every partial sum stays below EXACT."""
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact else q @ x.T


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row its k highest columns, ties to the left."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


class Index:
    """A pivot-distance index of a table's vectors in the shared folder: sorted annuli of at most TILE rows for each pivot.

    Fitted on a sample of SAMPLE rows (those with the least hashes of their numbers); every row is indexed. The key of a row is
    (nearest pivot, distance, number of the row), by which rows are dealt out in ranges, so that a third of all rows may be
    equal. Rows whose id is a query's are found on the way, with the k-th score within their own annulus as a first bound.
    """

    def __init__(self, table: DataFrame, id_col: str, vector: str, k: int, every: int, scale: int = SCALE, pivots: int = PIVOTS) -> None:
        self.spark, self.k = table.sparkSession, k
        rows, _ = common.write_table(scaled(table, id_col, vector, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
        self.n, top, dims = rows.agg(F.count("*"), F.max("norm"), F.max(F.size("x"))).first()
        self.dims, self.top = max(1, dims or 0), top or 0.0
        if self.top >= 1 << 62:
            raise ValueError("components are too large: their products don't fit 64 bits")
        self.exact = self.top < EXACT
        sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("x").toArrow() if self.n else None
        self.pivots = choose_pivots(lifted(matrix(sample["x"].combine_chunks(), self.dims), self.top), pivots) if self.n else np.zeros((0, 2))
        self.tiles, _ = common.write_table(self._tiles(rows, every).withColumn("tile", F.monotonically_increasing_id()), "annuli")

    def _tiles(self, rows: DataFrame, every: int) -> DataFrame:
        pivots, dims, top, k, exact = self.pivots, self.dims, self.top, self.k, self.exact

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.small(batches):
                d = distances(lifted(matrix(b["x"], dims), top), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b["row"], b["id"], b["x"], pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], ["row", "id", "x", "pivot", "dist"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b for b in batches if b.num_rows):
                pivot, dist, own = b["pivot"].to_numpy(), b["dist"].to_numpy(), b["row"].to_numpy()
                x, ids = matrix(b["x"], dims), b["id"]
                cuts = np.flatnonzero(np.diff(pivot)) + 1
                cuts = [c for a, e in zip([0, *cuts], [*cuts, len(pivot)], strict=True) for c in range(a, e, TILE)]
                for a, e in zip(cuts, [*cuts[1:], len(pivot)], strict=True):
                    some = ids.slice(a, e - a)
                    asked = np.flatnonzero(some.is_valid().to_numpy(zero_copy_only=False) & (some.fill_null(0).to_numpy() % every == 0))
                    low = _kth(x[a:e][asked], x[a:e], asked, k, exact)
                    queries = [{"at": int(i), "row": int(own[a + i]), "id": some[int(i)].as_py(), "low": None if s is None else int(s)} for i, s in zip(asked, low, strict=True)]
                    yield pa.RecordBatch.from_pylist([{"pivot": int(pivot[a]), "lo": float(dist[a]), "hi": float(dist[e - 1]), "rows": own[a:e].tolist(), "ids": some.to_pylist(), "x": x[a:e].tobytes(), "asked": queries}], schema=_TILE)

        d = rows.select("row", "id", "x").mapInArrow(keyed, "row long, id long, x array<long>, pivot int, dist double")
        sort = ["pivot", "dist", "row"]
        return d.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(packed, "pivot int, lo double, hi double, rows array<long>, ids array<long>, x binary, asked array<struct<at int, row long, id long, low long>>")

    def groups(self) -> DataFrame:
        """Queries that are searched together: (grp, rows, ids, low, x, far), with far the distances to all pivots.

        Whole pivots are put together up to QUERIES rows; those with more are dealt over several groups. The driver sees one
        number a pivot."""
        dims, top, pivots = self.dims, self.top, self.pivots
        q = self.tiles.select("pivot", F.explode("asked").alias("a"), F.col("x").alias("all")).select("pivot", "a.row", "a.id", "a.low", F.expr(f"substring(all, a.at * {8 * dims} + 1, {8 * dims})").alias("x"))
        first, parts, used, free = {}, {}, 0, 0
        for p, n in sorted(self.tiles.groupBy("pivot").agg(F.sum(F.size("asked"))).collect()):
            if n > free:
                first[p], parts[p] = used, -(-n // QUERIES)
                used += parts[p]
                free = QUERIES * parts[p] - n
            else:
                first[p], parts[p] = used - 1, 1
                free -= n
        of = lambda m: F.element_at(F.create_map(*[F.lit(int(y)) for x in m.items() for y in x]), F.col("pivot"))

        def gather(key: tuple, t: pa.Table) -> pa.Table:
            x = np.frombuffer(b"".join(t["x"].to_pylist()), np.int64).reshape(t.num_rows, dims)
            far = distances(np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], 1), pivots)
            return pa.Table.from_pylist([{"grp": key[0].as_py(), "rows": t["row"].to_pylist(), "ids": t["id"].to_pylist(), "low": t["low"].to_pylist(), "x": x.tobytes(), "far": far.tobytes()}], schema=_GROUP)

        if not first:
            return self.spark.createDataFrame([], "grp long, rows array<long>, ids array<long>, low array<long>, x binary, far binary")
        q = q.withColumn("grp", (of(first) + F.pmod(F.xxhash64("row"), of(parts))).cast("long")).select("grp", "row", "id", "low", "x")
        return q.groupBy("grp").applyInArrow(gather, "grp long, rows array<long>, ids array<long>, low array<long>, x binary, far binary")

    def search(self) -> DataFrame:
        """(row, id, rank, found, score): for every query its k best rows but its own, ties to smaller ids, null ids last."""
        dims, top, pivots, k, exact = self.dims, self.top, self.pivots, self.k, self.exact
        groups, _ = common.write_table(self.groups(), "queries")
        slack = 1e-7 * np.sqrt(top) + 1e-9

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each pivot between which distances from it the queries of a group can have anything to find."""
            for b in batches:
                for g, x, far, low in zip(b["grp"], b["x"], b["far"], b["low"], strict=True):
                    d, r = _far(far.as_py(), len(pivots)), _radius(_unpack(x.as_py(), dims), _low(low.as_py()), top) + slack
                    yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * len(pivots), pa.int64()), pa.array(range(len(pivots)), pa.int32()), pa.array((d - r[:, None]).min(0)), pa.array((d + r[:, None]).max(0))], ["grp", "pivot", "down", "up"])

        parts = max(1, -(-self.tiles.count() // PART))
        wide = groups.select("grp", "low", "x", "far").mapInArrow(reach, "grp long, pivot int, down double, up double").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        rings = self.tiles.select("tile", "pivot", "lo", "hi").withColumn("d", F.pmod(F.xxhash64("tile"), F.lit(DEALT)).cast("int"))
        pairs = rings.join(wide, ["pivot", "d"]).where("lo <= up AND hi >= down").select("grp", "tile", F.pmod(F.xxhash64("tile", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
        pairs, _ = common.write_table(pairs, "pairs")
        work = pairs.join(self.tiles.select("tile", "pivot", "lo", "hi", "rows", "ids", "x"), "tile")
        # A group's queries go to all its parts: not from one task.
        deal = F.pmod("p", F.lit(DEALT))
        some = groups.withColumnRenamed("grp", "g").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        asked = pairs.select(F.col("grp").alias("g"), F.col("part").alias("p")).distinct().withColumn("d", deal).join(some, ["g", "d"]).drop("d")

        def look(key: tuple, tiles: pa.Table, queries: pa.Table) -> pa.Table:
            q = queries.slice(0, 1).to_pylist()[0]
            x, far, low = _unpack(q["x"], dims), _far(q["far"], len(pivots)), _low(q["low"])
            own = np.array(q["rows"], np.int64)
            best = Best(len(x), k)
            gap = np.stack([np.maximum(0, np.maximum(far[:, p] - hi, lo - far[:, p])) for p, lo, hi in zip(tiles["pivot"].to_pylist(), tiles["lo"].to_pylist(), tiles["hi"].to_pylist(), strict=True)], 1)
            for t in np.argsort(gap.min(0), kind="stable").tolist():  # outwards
                floor = np.fmax(low, best.floor())
                need = np.flatnonzero(gap[:, t] <= _radius(x, floor, top) + slack)
                if len(need):
                    one = tiles.slice(t, 1)
                    ids = one["ids"][0].values
                    rows, order = one["rows"][0].values.to_numpy(), _by_id(ids)
                    s = products(x[need], _unpack(one["x"][0].as_py(), dims)[order], exact)
                    best.offer(need, s, floor[need], rows[order], ids.take(pa.array(order)), own[need])
            return best.table(own, q["ids"])

        found = work.groupBy("grp", "part").cogroup(asked.groupBy("g", "p")).applyInArrow(look, "row long, id long, other long, found long, score long")
        by = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("found").asc_nulls_last(), "other")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("row", "id", "rank", "found", "score")


_TILE = pa.schema([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("asked", pa.list_(pa.struct([("at", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("low", pa.int64())])))])
_GROUP = pa.schema([("grp", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("x", pa.binary()), ("far", pa.binary())])
_FOUND = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("other", pa.int64()), ("found", pa.int64()), ("score", pa.int64())])


def _far(data: bytes, pivots: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, pivots)


def _low(values: list) -> np.ndarray:
    """Bounds of scores; none is minus infinity."""
    return np.array([-np.inf if v is None else v for v in values], np.float64)


def _radius(x: np.ndarray, low: np.ndarray, top: float) -> np.ndarray:
    """How far from a query a vector may be whose score reaches the bound."""
    f = x.astype(np.float64)
    with np.errstate(over="ignore"):
        return np.sqrt(np.maximum(0, (f * f).sum(1) + top - 2 * low))


def _by_id(ids: pa.Array) -> np.ndarray:
    """The order of the ids, nulls last; rows of one id stay in their order."""
    none = ids.is_null().to_numpy(zero_copy_only=False)
    return np.lexsort((ids.fill_null(0).to_numpy(), none))


def _kth(q: np.ndarray, x: np.ndarray, at: np.ndarray, k: int, exact: bool) -> list:
    """The k-th score of each query among the rows but its own, in place `at`; None where there are fewer."""
    if len(x) <= k or not len(q):
        return [None] * len(q)
    s = products(q, x, exact)
    s[np.arange(len(q)), at] = np.iinfo(np.int64).min
    return np.partition(s, -k, axis=1)[:, -k].tolist()


class Best:
    """The k best of each of so many queries: score, id (and whether it's null) and row number, best first."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.count = k, np.zeros(queries, np.int64)
        self.score, self.id, self.none, self.row = (np.zeros((queries, k), t) for t in (np.int64, np.int64, bool, np.int64))

    def floor(self) -> np.ndarray:
        """The k-th score; minus infinity as long as there are fewer."""
        return np.where(self.count == self.k, self.score[:, -1].astype(np.float64), -np.inf)

    def offer(self, need: np.ndarray, scores: np.ndarray, floor: np.ndarray, rows: np.ndarray, ids: pa.Array, own: np.ndarray) -> None:
        """Take in the scores of queries `need` with rows ordered by id."""
        other = rows[None, :] != own[:, None]
        some = np.flatnonzero(((scores >= floor[:, None]) & other).any(1))
        if not len(some):
            return
        none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        s, keep = scores[some], other[some]
        s = np.where(keep, s, -np.iinfo(np.int64).max)  # the query's own row comes last
        c = best_columns(s, self.k)
        take = np.take_along_axis
        new = take(s, c, 1), ids[c], none[c], rows[c], take(keep, c, 1)
        q = need[some]
        held = np.arange(self.k) < self.count[q][:, None]
        old = self.score[q], self.id[q], self.none[q], self.row[q], held
        score, of, null, row, real = (np.concatenate(x, 1) for x in zip(old, new, strict=True))
        order = np.lexsort((row, of, null, -score, ~real), axis=1)[:, : self.k]
        self.count[q] = np.minimum(self.k, real.sum(1))
        for a, b in ((self.score, score), (self.id, of), (self.none, null), (self.row, row)):
            a[q] = take(b, order, 1)

    def table(self, own: np.ndarray, ids: list) -> pa.Table:
        held = np.arange(self.k) < self.count[:, None]
        q = np.repeat(np.arange(len(own)), self.count)
        found = pa.array(self.id[held], pa.int64(), mask=self.none[held])
        return pa.Table.from_arrays([pa.array(own[q]), pa.array(ids, pa.int64()).take(pa.array(q)), pa.array(self.row[held]), found, pa.array(self.score[held])], schema=_FOUND)


def nearest(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` its k highest inner products with all others.

    Components are floor(1024 * x). Vectors that are null or hold null or non-finite components take no part; shorter ones
    count as filled with zeros. Rows that repeat an id are rows of their own, as queries and as what is found; a null id is
    no query and comes last among ties. Fewer rows than k give all; an empty table gives none. Other columns play no part.
    Squared lengths, as integers, must stay under 2**62, or it's an error.
    """
    with common.dropping() as kept:  # the result is k rows a query; the index goes
        found = Index(table, id_col, vector, k, every, **how).search()
        out, at = common.write_table(found.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("vec_id"), "score"), "nearest")
        kept.append(at)
    return out


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest scores of every query of embeddings, those whose vec_id is divisible by 100, against all other rows.

    Nulls, repeated ids, ties and short vectors as in nearest()."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, b.r AS other, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
t AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10
"""
