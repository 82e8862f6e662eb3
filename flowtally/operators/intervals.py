"""Points inside intervals, by cells of two widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line import free_name

#: Widths of the cells, the second a multiple of the first.
WIDTHS = (1, 32)


def cells(first: Column, last: Column, widths: tuple[int, int] = WIDTHS) -> Column:
    """An array of (level, cell) that covers first..last (integers, both inside) without overlap: wide cells that lie inside
    altogether, and narrow ones on both sides. Their number is the length divided by the wide width, and twice the
    ratio of the widths at most. Empty where the end is before the start."""
    narrow, wide = widths
    a, z = F.ceil(first / wide), F.floor((last + 1) / wide) - 1  # wide cells inside
    run = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
    some = lambda level, array: F.transform(array, lambda c: F.struct(F.lit(level).alias("level"), c.cast("long").alias("cell")))
    small = lambda x, y: run(F.floor(x / narrow), F.when(x <= y, F.floor(y / narrow)).otherwise(F.floor(x / narrow) - 1))
    sides = F.concat(small(first, a * wide - 1), small((z + 1) * wide, last))
    return F.when(first > last, some(0, F.array().cast("array<bigint>"))).when(a <= z, F.concat(some(1, run(a, z)), some(0, sides))).otherwise(some(0, small(first, last)))


def inside(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, keys: list[str] = (), widths: tuple[int, int] = WIDTHS) -> DataFrame:
    """Every pair of a point and a span with equal keys that holds it: the columns of both, each pair once.

    at, start and end are columns of integers (days, seconds); both ends are inside, a null is in nothing. A point is looked up
    in its two cells, a span is there once for each cell of cells(), so that a long span costs wide cells and no row for
    every day. An equi-join on keys and cell: nothing is broadcast unseen, and a cell with very many points is split by adaptive
    execution. Other columns must differ in name.
    """
    level, cell, c = free_name(points, "level"), free_name(points, "cell"), free_name(points, "c")
    p = points.where(F.col(at).isNotNull()).withColumn(c, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(at) / w).alias("cell")) for k, w in enumerate(widths)])))
    s = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn(c, F.explode(cells(F.col(start), F.col(end), widths)))
    of = lambda d: d.withColumns({level: F.col(f"{c}.level"), cell: F.col(f"{c}.cell")}).drop(c)
    j = of(p).join(of(s), [*keys, level, cell])
    return j.where(F.col(at).between(F.col(start), F.col(end))).drop(level, cell)
