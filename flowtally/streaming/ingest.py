"""Incremental ingest: files that came, changed or went replace their months, as a stream of arrivals with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize
from ..session import lineage_cut
from ..sources import records, tables

#: uri is what records call a file, path how it is opened.
ARRIVAL = "path string, uri string, modified timestamp, length long, gone boolean, noted timestamp"
FILE = "path string, uri string, year_month string, gone boolean, batch long"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def latest(df: DataFrame, by: str) -> DataFrame:
    """The row of each path with the highest value of a column."""
    w = Window.partitionBy("path").orderBy(F.desc(by))
    return df.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def note_arrivals(spark: SparkSession, raw: str, state: str, name_pattern: str = r"20(18|19|20|21)", exclude: str = "output.txt") -> int:
    """Look at the files under raw, and add a row to {state}/arrivals for each that is new, has another time or length than when it
    was last noted, or is gone; how many. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(raw)
    name = F.element_at(F.split("path", "/"), -1)
    now = files.where(name.rlike(name_pattern) & (F.lower(name) != exclude)).select("path", F.col("_metadata.file_path").alias("uri"), F.col("modificationTime").alias("modified"), "length")
    path = f"{state}/arrivals"
    known = latest(spark.read.schema(ARRIVAL).parquet(path), "noted").where("NOT gone") if exists(spark, path) else spark.createDataFrame([], ARRIVAL)
    new = now.join(known, ["path", "modified", "length"], "left_anti").withColumn("gone", F.lit(False))
    gone = known.join(now, "path", "left_anti").select("path", "uri", "modified", "length").withColumn("gone", F.lit(True))
    rows = lineage_cut(new.unionByName(gone).withColumn("noted", F.current_timestamp()))
    n = rows.count()
    if n or not exists(spark, path):
        rows.write.mode("append").parquet(path)
    return n


def facts(got: DataFrame, months: DataFrame, channels: DataFrame, minimum: float) -> DataFrame:
    """Normalized facts of records by the month of their file; months: (source_file, year_month)."""
    fact = normalize.coverage(got.join(months, "source_file"), normalize.channel_map(channels), minimum)
    return fact.drop("channels", "ts_pos", "block_pos")


def replace_months(batch: DataFrame, number: int, channels: DataFrame, state: str, out: str, minimum: float, sentinels: tuple[int, ...]) -> None:
    """Bring {out}/fact up to date with a batch of arrivals.

    The months of files that came or went, and those that they had before, are made anew from all their files; a month that
    has none left is deleted. What is known of files after each batch is written last, to {state}/files/batch=N, and only
    earlier batches are read: a batch that was broken off anywhere can run again and gives the same.
    """
    spark = batch.sparkSession
    files = f"{state}/files"
    known = latest(spark.read.schema(FILE).parquet(files).where(F.col("batch") < number), "batch") if exists(spark, files) else spark.createDataFrame([], FILE)
    arrived = {r.path: r for r in latest(batch, "noted").select("path", "uri", "gone").collect()}  # the names of files, as a listing has them
    if not arrived:
        return
    came = sorted(p for p, r in arrived.items() if not r.gone)
    read = lambda paths: records.assembled(records.lines(spark, paths), sentinels, with_path=True)
    month = {r.source_file: r.source_month for r in records.file_months(read(came)).collect()} if came else {}
    mine = known.where(F.col("path").isin(list(arrived)))
    touched = sorted({*month.values(), *(r[0] for r in mine.where("NOT gone").select("year_month").distinct().collect() if r[0])})
    others = {r.path: r for r in known.where(~F.col("path").isin(list(arrived)) & ~F.col("gone") & F.col("year_month").isin(touched)).collect()}
    named = {**month, **{r.uri: r.year_month for r in others.values()}}
    paths = sorted([*others, *(p for p in came if arrived[p].uri in month)])
    if paths:
        months = spark.createDataFrame(list(named.items()), "source_file string, year_month string")
        fact = facts(read(paths), months, channels, minimum)
        fact = fact.withColumn("source_file", records.file_name(F.col("source_file")))
        tables.write_months(fact, f"{out}/fact")
    left = set(named.values())
    for m in touched:
        if m not in left:
            delete(spark, f"{out}/fact/year_month={m}")
    rows = [(p, r.uri, month.get(r.uri), r.gone) for p, r in sorted(arrived.items())]
    spark.createDataFrame(rows, "path string, uri string, year_month string, gone boolean").write.mode("overwrite").parquet(f"{files}/batch={number}")


def follow(spark: SparkSession, channels: DataFrame, state: str, out: str, minimum: float, sentinels: tuple[int, ...] = (2046, 2047), files: int = 100, apply: Callable = replace_months, **trigger) -> StreamingQuery:
    """A query that takes what note_arrivals() has noted and replace_months() hasn't seen, `files` tables of arrivals at once; by default
    it ends when all is done (trigger: availableNow). It goes on where its checkpoint under state says."""
    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files).parquet(f"{state}/arrivals")
    write = stream.writeStream.option("checkpointLocation", f"{state}/checkpoint").trigger(**(trigger or {"availableNow": True}))
    return write.foreachBatch(lambda batch, number: apply(batch, number, channels, state, out, minimum, sentinels)).start()
