"""Nearest rows of a metric without all pairs: tiles of like rows, and only those pairs of tiles that can hold something."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import lineage_cut

#: Pivots, the sample (rows with the least hashes) they are chosen from, and rows of a tile at most.
PIVOTS, SAMPLE, ROWS = 64, 2048, 1024

#: Tiles of a group at most: what is sent grows with the square of the rows over this.
GROUP = 64

Look = Callable[[dict[int, tuple[np.ndarray, np.ndarray]], list[tuple[int, int]]], dict[str, np.ndarray]]


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k different rows of x, each the farthest from those before it, the first of equals."""
    chosen, gap = [0], np.full(len(x), np.inf)
    for _ in range(k - 1):
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
        if gap.max() <= 0:
            break
        chosen.append(int(gap.argmax()))
    return x[chosen]


def _rows(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), dims)


class Tiles:
    """Rows of z (site, z: equally long arrays) in tiles: each has rows of one nearest pivot, at distances lo to hi from it, and how
    far its rows have to look (reach).

    reach(x) gives, for the rows of a tile, a distance within which everything lies that any row of the table needs from
    it or it needs from others, as far as the tile itself tells: the farthest is the tile's. Rows are dealt out in ranges of
    (pivot, distance, site), so a pivot that most rows are near to has many tiles. A task holds one tile, or two groups of them.
    """

    def __init__(self, z: DataFrame, reach: Callable[[np.ndarray], np.ndarray], pivots: int = PIVOTS, rows: int = ROWS, *, held: bool = False) -> None:
        self.spark = z.sparkSession
        z = z.select(F.col("site").cast("long").alias("site"), "z")
        z = z if held else lineage_cut(z)
        self.n, dims = z.agg(F.count("*"), F.max(F.size("z"))).first()
        self.dims = dims = dims or 0
        some = z.orderBy(F.xxhash64("site"), "site").limit(SAMPLE).select("z").toArrow()["z"].combine_chunks()
        self.pivots = heads = spread(_rows(some, dims), pivots) if self.n else np.zeros((0, 0))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    x = _rows(part["z"], dims)
                    d = np.stack([np.linalg.norm(x - h, axis=1) for h in heads], 1)
                    near = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([part["site"], part["z"], pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], ["site", "z", "pivot", "dist"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b for b in batches if b.num_rows):
                pivot, dist, site, x = b["pivot"].to_numpy(), b["dist"].to_numpy(), b["site"].to_numpy(), _rows(b["z"], dims)
                edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
                cuts = [c for a, e in zip(edges, edges[1:], strict=False) for c in range(a, e, rows)] + [len(pivot)]
                for a, e in zip(cuts, cuts[1:], strict=False):
                    one = {"pivot": int(pivot[a]), "lo": float(dist[a]), "hi": float(dist[e - 1]), "reach": float(reach(x[a:e]).max()), "sites": site[a:e].tolist(), "x": x[a:e].tobytes()}
                    yield pa.RecordBatch.from_pylist([one], schema=_TILE)

        d = z.mapInArrow(keyed, "site long, z array<double>, pivot int, dist double")
        order = ["pivot", "dist", "site"]
        tiles = d.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, "pivot int, lo double, hi double, reach double, sites array<long>, x binary")
        self.tiles = lineage_cut(tiles.withColumn("tile", F.monotonically_increasing_id()))

    def pairs(self) -> DataFrame:
        """(a, b), a <= b: the pairs of tiles whose rows may be within reach of each other, by the triangle inequality over their
        pivots. Only tiles' outlines meet here."""
        gaps = [(p, q, float(np.linalg.norm(self.pivots[p] - self.pivots[q]))) for p in range(len(self.pivots)) for q in range(len(self.pivots))]
        gap = F.broadcast(self.spark.createDataFrame(gaps, "p_a int, p_b int, d double"))  # a row for every two pivots
        of = lambda k: self.tiles.select(F.col("tile").alias(k), *[F.col(c).alias(f"{s}_{k}") for c, s in (("pivot", "p"), ("lo", "lo"), ("hi", "hi"), ("reach", "reach"))])
        j = of("a").join(gap, "p_a").join(of("b"), "p_b").where("a <= b")
        least = F.greatest(F.col("d") - F.col("hi_a") - F.col("hi_b"), F.col("lo_a") - F.col("d") - F.col("hi_b"), F.col("lo_b") - F.col("d") - F.col("hi_a"))
        slack = 1e-9 * (F.col("d") + F.col("hi_a") + F.col("hi_b") + 1)
        return j.where(least <= F.greatest("reach_a", "reach_b") + slack).select("a", "b")

    def looked(self, look: Look, schema: str) -> DataFrame:
        """Rows that look(tiles, pairs) gives: tiles are (sites, matrix) by their numbers, pairs those of them to compare.

        Tiles are put to groups, as many that there are pairs of groups for all tasks, or as many more as it takes for groups of
        GROUP tiles: a task holds two groups at a time. A tile is sent once for each group that it has a partner in, not for each
        partner, and look() can put together what it finds for a row in all tiles of a group."""
        dims = self.dims
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        m = max(1, math.isqrt(2 * tasks))
        size = min(GROUP, max(1, -(-self.tiles.count() // m)))
        group = lambda c: (F.shiftright(c, 33) * (1 << 32) + F.floor(F.col(c).bitwiseAND(F.lit((1 << 33) - 1)) / size)).cast("long")

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("tile")
            of, pairs = {}, []
            for k, partners, sites, x in zip(t["tile"].to_pylist(), t["partners"].to_pylist(), t["sites"], t["x"], strict=True):
                of[k] = sites.values.to_numpy(), np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dims)
                pairs += [(k, j) for j in sorted(partners or ())]
            return pa.Table.from_pydict(look(of, pairs))

        p = self.pairs().select(group("a").alias("i"), group("b").alias("j"), "a", "b")
        own = p.groupBy("i", "j", F.col("a").alias("tile")).agg(F.collect_list("b").alias("partners"))
        needed = own.unionByName(p.select("i", "j", F.col("b").alias("tile"), F.lit(None).cast("array<long>").alias("partners"))).groupBy("i", "j", "tile").agg(F.flatten(F.collect_list("partners")).alias("partners"))
        return needed.join(self.tiles.select("tile", "sites", "x"), "tile").repartition(max(tasks, m * (m + 1) // 2), "i", "j").groupBy("i", "j").applyInArrow(run, schema)


_TILE = pa.schema([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("reach", pa.float64()), ("sites", pa.list_(pa.int64())), ("x", pa.binary())])
