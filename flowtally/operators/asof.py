"""Nearest rows in time, before and after, of the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line import Line, free_name


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, carry: list[str], block: int | None = None) -> DataFrame:
    """left with `before` and `after`: structs (at, carry...) of the nearest rows of right with equal keys, at or before a row's time
    and at or after it; null where there is none.

    Both are put in one order of keys and time, in which the last row of right is carried forwards and the next one
    backwards, by blocks of rows: a key with any share of all rows is split like others. Where times are equal both are the same
    row of right, the last in the order of `carry`; among rows of right of one later time `after` takes the first. Rows
    with a null key or time have no neighbours; right's are left out. Columns `before` and `after` of left are replaced.
    """
    mine = [c for c in left.columns if c not in ("before", "after")]
    kind, other, prev, follow = (free_name(left, x) for x in ("kind", "other", "prev", "follow"))
    row = F.struct(*keys, F.col(at).alias("at"), F.struct(F.col(at).alias("at"), *carry).alias("row"))
    known = F.col(at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    r = right.where(known).select(*[F.col(c) if c in (*keys, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in mine], F.lit(0).alias(kind), row.alias(other))
    both = left.select(*mine, F.lit(1).alias(kind)).withColumn(other, F.lit(None).cast(r.schema[other].dataType)).unionByName(r)
    order = [*[F.col(k) for k in keys], F.col(at), F.col(kind), F.col(other), F.xxhash64(*[c for c in mine if c not in (*keys, at)])]
    line = Line(both, order, block)
    line.rows = line.with_last({prev: F.col(other)})
    d = line.with_last({follow: F.col(other)}, back=True).where(F.col(kind) == 1)
    same = lambda s: known & F.col(f"{s}.at").isNotNull()
    for s in (prev, follow):
        ok = same(s)
        for k in keys:
            ok = ok & (F.col(f"{s}.{k}") == F.col(k))
        d = d.withColumn(s, F.when(ok, F.col(s)))
    d = d.withColumn(follow, F.when(F.col(f"{prev}.at") == F.col(at), F.col(prev)).otherwise(F.col(follow)))
    return d.select(*mine, F.col(f"{prev}.row").alias("before"), F.col(f"{follow}.row").alias("after"))
