"""Embedding whitening: principal components of the distinct vectors by Spark MLlib's SVD of the centred rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .topk_search import matrix

SCALE, SHIFT, MOST = 64, 1_000_000, 16
#: A component counts if its eigenvalue is more than this share of the largest; below, a double's noise would be scaled up.
LEAST = 1e-12


def shifted(table: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """table with x, its vectors as longs floor(scale * component) + shift, without rows whose vector is null or holds null or
    non-finite entries. Shorter vectors are filled with the number of a zero. A column x is replaced."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    d = table.where(F.col(vector).isNotNull() & ~F.exists(vector, bad)).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long")))
    return d


class Whitener:
    """Sums, deviations and principal components of the distinct x vectors of a table (x: array of longs).

    n and sums are exact integers. The centred rows (n * x - sum) / n are exact integers until the one division, and go to
    MLlib's RowMatrix.computeSVD; singular values s become eigenvalues s^2 / n. The total variance comes from the
    exact deviations, not from the singular values. The driver holds the sums and MLlib's matrix of products of columns (dims^2
    doubles), whatever the number of rows. All components are asked for, so that MLlib takes LAPACK's decomposition of that
    matrix (up to 15,000 dimensions), which is right to the last digits, and no iteration to a tolerance.
    """

    def __init__(self, x: DataFrame, most: int = MOST, fill: int = SHIFT) -> None:
        spark = x.sparkSession
        self.dims = x.agg(F.max(F.size("x"))).first()[0] or 0
        self.fill = fill
        self.fit, self.path = common.write_table(x.select(self.filled(F.col("x")).alias("x")).distinct(), "fit")
        wide = lambda i: F.col("x")[i].cast("decimal(38,0)")
        # Sums of all dimensions in one row, made in every task before they are shuffled.
        got = self.fit.agg(F.count("*"), *[F.sum(wide(i)) for i in range(self.dims)]).first()
        self.n, self.sums = got[0], [int(s) for s in got[1:]] if got[0] else []
        self.values, self.components, self.explained, self.error = np.zeros(0), np.zeros((self.dims, 0)), np.zeros(0), None
        if self.n < 2 or not self.dims:
            return
        total = self.fit.agg(F.sum(self.deviation(F.col("x")))).first()[0]
        if not total:
            return
        rows = MLUtils.convertVectorColumnsFromML(self.fit.select(array_to_vector(self.centred(F.col("x"))).alias("v")), "v")
        svd = RowMatrix(rows).computeSVD(self.dims, False, np.sqrt(LEAST))
        e = np.asarray(svd.s.toArray()) ** 2 / self.n
        c = svd.V.toArray()[:, : len(e)]
        keep = np.flatnonzero(e > LEAST * e[0])[:most]
        c = c[:, keep]
        c = c * np.sign(c[np.abs(c).argmax(0), np.arange(len(keep))])  # the largest entry is positive
        self.values, self.components = e[keep], c
        # trace(V) = sum of (n x - S)^2 / n^3 over the fit list
        self.explained = self.values * (float(self.n) ** 3 / float(total))
        self.error = self._identity_error(spark)

    def filled(self, x: Column) -> Column:
        return F.concat(x, F.array_repeat(F.lit(self.fill).cast("long"), F.lit(self.dims) - F.size(x)))

    def _sums(self) -> Column:
        return F.from_json(F.lit(str(self.sums)), "array<decimal(38,0)>")

    def centred(self, x: Column) -> Column:
        """x - mean as doubles, rounded once."""
        n = F.lit(self.n).cast("decimal(19,0)")
        off = F.zip_with(x, self._sums(), lambda v, s: (v.cast("decimal(19,0)") * n - s).cast("double") / F.lit(float(self.n)))
        return off

    def deviation(self, x: Column) -> Column:
        """The sum over dimensions of (n * x - sum)^2, exact."""
        n = F.lit(self.n).cast("decimal(19,0)")
        square = lambda d: (d * d).cast("decimal(38,0)")
        each = F.zip_with(x, self._sums(), lambda v, s: square((v.cast("decimal(19,0)") * n - s).cast("decimal(19,0)")))
        return F.aggregate(each, F.lit(0).cast("decimal(38,0)"), lambda a, b: (a + b).cast("decimal(38,0)"))

    def project(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (with a column `centred`) with an array of the whitened values, in batches of numpy."""
        scale = self.components / np.sqrt(self.values)
        schema = rows.drop("centred").withColumn(name, F.array(F.lit(0.0))).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.small(batches):
                w = np.ascontiguousarray(matrix_of(b["centred"], scale.shape[0]) @ scale)
                out = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
                names = [x for x in b.schema.names if x != "centred"]
                yield pa.RecordBatch.from_arrays([*[b[x] for x in names], out], [*names, name])

        return rows.mapInArrow(run, schema)

    def _identity_error(self, spark: SparkSession) -> float:
        """The largest absolute entry of the whitened fit list's covariance (divisor n, centred first) less the identity."""
        w, at = common.write_table(self.project(self.fit.select(self.centred(F.col("x")).alias("centred")), "w"), "whitened")
        k = len(self.values)
        mean = list(w.agg(*[F.avg(F.col("w")[i]) for i in range(k)]).first())
        off = F.zip_with("w", F.array(*[F.lit(m) for m in mean]), lambda a, m: a - m)
        rows = MLUtils.convertVectorColumnsFromML(w.select(array_to_vector(off).alias("v")), "v")
        g = RowMatrix(rows).computeGramianMatrix().toArray()
        common.drop_table(spark, at)
        return float(np.abs(g / self.n - np.eye(k)).max())


def matrix_of(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), dims)


def whitened(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component, from 1, by falling variance.

    The fit list has each distinct vector once; every row is given. Null vectors and those with null or non-finite entries
    are dropped, shorter ones count as filled with zeros, rows that repeat give rows that repeat, a null id stays null.
    Components without variance (LEAST of the largest) can't be whitened and aren't given, so a table whose vectors are
    all equal, or an empty one, gives no rows. A deviation that doesn't fit a long is null. Other columns play no part.
    """
    spark = table.sparkSession
    rows, _ = common.write_table(shifted(table.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "v").select("id", "x"), "shifted")
    w = Whitener(rows, most)
    k = len(w.values)
    if not k:
        common.drop_table(spark, w.path)
        return spark.createDataFrame([], rows.select("id").schema).selectExpr("id", "CAST(0 AS INT) AS component", "CAST(0 AS LONG) AS n", "CAST(0 AS LONG) AS deviation", "CAST(0 AS DOUBLE) AS whitened", "CAST(0 AS DOUBLE) AS explained", "CAST(0 AS DOUBLE) AS identity_error")
    x = w.filled(F.col("x"))
    d = w.project(rows.select("id", w.deviation(x).try_cast("long").alias("deviation"), w.centred(x).alias("centred")), "w")
    common.drop_table(spark, w.path)
    values = F.arrays_zip(F.col("w").alias("w"), F.array(*[F.lit(float(v)) for v in w.explained]).alias("e"))
    d = d.select("id", "deviation", F.posexplode(values).alias("at", "v"))
    return d.select("id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", F.col("v.w").alias("whitened"), F.col("v.e").alias("explained"), F.lit(w.error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings on up to 16 whitened components of the distinct vectors.

    Nulls, repeats, short vectors and components without variance as in whitened()."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")
