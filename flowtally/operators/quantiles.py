"""Exact quantiles of groups of any size: brackets first, then only what lies in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Approximate quantiles are off by a share of 1 / ACCURACY of a group at most; brackets are WIDER times as wide on either side.
ACCURACY, WIDER = 10_000, 4
#: Steps of the sketch between which a bracket can begin and end.
GRID = 1000
#: Groups of up to so many values are their own bracket: a bracket of one that is larger reaches over several ranks.
SMALL = 5_000


def exact(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], rounds: int = 2) -> DataFrame:
    """(keys, n, and a column for each of the shares): quantiles of the values that aren't null, with linear interpolation between
    neighbours, as percentile() gives them.

    percentile() holds all different values of a group in one task. Here every round takes, from summaries of fixed size, a
    bracket that holds the wanted rank for sure, and goes on with the values in it, some 0.4 % of them. What is left after the
    last round is counted by value, and the running counts of one group and share tell the values at the rank.
    The table is read once for each round and once at the end, so it should be a written one. Groups without values give
    no row. If a bracket should miss its rank, it's an error, not another number.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    names, by = list(shares), [*keys, "share"]
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    sketch = lambda x: F.percentile_approx(x, grid, F.lit(ACCURACY)).alias("q")

    def narrowed(b: DataFrame) -> DataFrame:
        """Brackets (low, high) about the rank, which is so many shares of the `held` values that the sketch is of."""
        part, reach = (F.col("rank") - F.col("below")) / F.greatest(F.col("held") - 1, F.lit(1)), 2 * WIDER / ACCURACY + 1 / GRID
        low = F.when((F.col("held") > SMALL) & (part - reach > 0), F.get("q", F.floor((part - reach) * GRID).cast("int")))
        high = F.when((F.col("held") > SMALL) & (part + reach < 1), F.get("q", F.ceil((part + reach) * GRID).cast("int")))
        return b.select(*by, "n", "rank", F.coalesce(low, "low").alias("low"), F.coalesce(high, "high").alias("high"))

    b = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), sketch("v")).where("n > 0")
    b = b.withColumns({"below": F.lit(0), "held": F.col("n"), "s": F.explode(F.array(*[F.struct(F.lit(k).alias("share"), F.lit(float(p)).alias("p")) for k, p in shares.items()]))})
    b = narrowed(b.withColumns({"share": F.col("s.share"), "rank": F.col("s.p") * (F.col("n") - 1)}))
    for _ in range(rounds - 1):
        inside = F.col("v") >= F.col("low")
        seen = _upto(v, b, keys).groupBy(*by).agg(F.count_if(~inside).alias("below"), F.count_if(inside).alias("held"), sketch(F.when(inside, F.col("v"))))
        b = narrowed(b.join(seen, by))
    # By value; what lies below the bracket is counted under null.
    found = _upto(v, b, keys).groupBy(*by, F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("rank").alias("rank"))
    w = Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("upto", F.sum("k").over(w))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    one = found.groupBy(*by).agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"), F.first("rank").alias("rank"), F.first("n").alias("n"), F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("upto"))), F.lit(0)).alias("below"))
    sure = F.when((F.col("below") <= F.floor("rank")) & F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank")))
    one = one.withColumn("x", F.coalesce(sure, F.raise_error(F.lit("a bracket missed its rank")).cast("double")))
    return one.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("share") == k, F.col("x"))).alias(k) for k in names]).where("n > 0")


def _upto(v: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every value with those brackets of its group that don't end before it. Without keys there are as many rows of b as shares."""
    return (v.join(b, keys) if keys else v.crossJoin(F.broadcast(b))).where("v <= high")
