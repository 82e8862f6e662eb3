"""Windows over the whole table in one order, without all rows in one task.

Rows get dense numbers: they are dealt out in ranges of the order, sorted and checkpointed, and the driver adds up how many each
range has (one number a range). By its number a row belongs to a block of BLOCK rows. Windows run within blocks; what goes on
across borders comes from the blocks before (one row a block, treated in the same way if these are many), or from copies of the
few rows at a border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import lineage_cut

BLOCK = 1 << 16


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> tuple[DataFrame, int]:
    """df with `name`, dense numbers from 1 in this order, checkpointed, and how many rows there are.

    Rows that are equal in the whole order lie in one range: give enough columns to tell apart what there is much of.
    """
    at = free_name(df, "at")
    rows = lineage_cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = free_name(rows, "part")
    rows = rows.withColumn(part, F.shiftright(at, 33).cast("int"))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part).agg(F.count("*")).collect())
    ahead, total = [], 0
    for k, n in sizes:
        ahead.append((k, total))
        total += n
    before = free_name(rows, "before")
    offsets = df.sparkSession.createDataFrame(ahead, f"`{part}` int, `{before}` long")
    rows = rows.join(F.broadcast(offsets), part)  # a row for each range
    return rows.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(at, part, before), total


class Line:
    """Rows of df in one order: `rows` has the column `n` with their dense numbers, which the caller drops in the end."""

    def __init__(self, df: DataFrame, order: list[Column], block: int | None = None) -> None:
        self.block, self.n = block or BLOCK, free_name(df, "n")
        self.rows, self.total = numbered(df, order, self.n)

    def _of(self, n: Column) -> Column:
        return F.floor((n - 1) / self.block)

    def with_near(self, back: int, ahead: int, columns: dict) -> DataFrame:
        """rows with columns {name: function of a window}: the window has up to `back` rows before and `ahead` rows after, of all."""
        n, b, own = F.col(self.n), free_name(self.rows, "block"), free_name(self.rows, "own")
        place = (n - 1) % self.block
        also = F.array(self._of(n), F.when(place >= self.block - back, self._of(n) + 1), F.when(place < ahead, self._of(n) - 1))
        if max(back, ahead) > self.block:
            raise ValueError("a window wider than a block")
        d = self.rows.withColumn(b, F.explode(F.array_compact(also))).withColumn(own, F.col(b) == self._of(n))
        w = Window.partitionBy(b).orderBy(n).rowsBetween(-back, ahead)
        return d.withColumns({k: f(w) for k, f in columns.items()}).where(own).drop(b, own)

    def with_last(self, columns: dict[str, Column], back: bool = False) -> DataFrame:
        """rows with, for each column, its last value at or before the row that isn't null (back: the first at or after it)."""
        return _carried(self.rows, self.n, self.total, self.block, columns, back)

    def with_sums(self, columns: dict[str, Column]) -> DataFrame:
        """rows with, for each column, its sum over all rows up to this one."""
        return _summed(self.rows, self.n, self.total, self.block, columns)


def _blocks(rows: DataFrame, n: str, total: int, block: int) -> tuple[DataFrame, str]:
    b = free_name(rows, "block")
    return rows.withColumn(b, F.floor((F.col(n) - 1) / block).cast("long") + 1), b


def _joined(d: DataFrame, ends: DataFrame, b: str, total: int, block: int) -> DataFrame:
    return d.join(F.broadcast(ends) if -(-total // block) <= BLOCK else ends, b, "left")


def _carried(rows: DataFrame, n: str, total: int, block: int, columns: dict[str, Column], back: bool) -> DataFrame:
    d, b = _blocks(rows, n, total, block)
    w = Window.partitionBy(b).orderBy(F.col(n).desc() if back else F.col(n)).rowsBetween(Window.unboundedPreceding, 0)
    inside = d.withColumns({k: F.last(v, True).over(w) for k, v in columns.items()})
    if total <= block:
        return inside.drop(b)
    far = {k: free_name(inside, f"far_{k}") for k in columns}
    nearest = F.min_by if back else F.max_by
    ends = d.groupBy(b).agg(*[nearest(v, F.when(v.isNotNull(), F.col(n))).alias(far[k]) for k, v in columns.items()])
    # The value that a block begins with is the last one of the blocks before.
    past = _carried(ends, b, -(-total // block), block, {k: F.col(k) for k in far.values()}, back)
    past = past.withColumn(b, F.col(b) + (-1 if back else 1))
    return _joined(inside, past, b, total, block).withColumns({k: F.coalesce(k, far[k]) for k in columns}).drop(b, *far.values())


def _summed(rows: DataFrame, n: str, total: int, block: int, columns: dict[str, Column]) -> DataFrame:
    d, b = _blocks(rows, n, total, block)
    w = Window.partitionBy(b).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    inside = d.withColumns({k: F.sum(v).over(w) for k, v in columns.items()})
    if total <= block:
        return inside.drop(b)
    far = {k: free_name(inside, f"far_{k}") for k in columns}
    ends = d.groupBy(b).agg(*[F.sum(v).alias(far[k]) for k, v in columns.items()])
    past = _summed(ends, b, -(-total // block), block, {k: F.col(k) for k in far.values()}).withColumn(b, F.col(b) + 1)
    add = lambda k: F.when(F.col(k).isNull() & F.col(far[k]).isNull(), None).otherwise(F.coalesce(k, F.lit(0)) + F.coalesce(far[k], F.lit(0)))
    return _joined(inside, past, b, total, block).withColumns({k: add(k) for k in columns}).drop(b, *far.values())
