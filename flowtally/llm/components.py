"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 60


def components(links: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, itself included.

    Self-links and repeated links change nothing; nodes without links have no row. Every round is two grouped minima
    and joins on them, so a node with very many links is summed before it is shuffled and its join can be split; each
    round is written to the shared folder. The number of rounds grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    edges, path = common.write_table(edges, "links")
    seen = None
    for _ in range(ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new, at = common.write_table(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        common.drop_table(spark, path)
        edges, path = new, at
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
