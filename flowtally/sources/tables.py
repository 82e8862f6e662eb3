"""Small inputs: columnar JSON, events, CSV dimensions; and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_columns(docs: DataFrame, value: str, field: str, names: list[str], times: str = "time") -> DataFrame:
    """Rows of a JSON object of equally long arrays, {field: {time: [...], name: [...]}}; nulls inside stay."""
    kinds = f"struct<{field}:struct<`{times}`:array<string>," + ",".join(f"`{n}`:array<double>" for n in names) + ">>"
    got = docs.select(*[c for c in docs.columns if c != value], F.from_json(value, kinds).getField(field).alias("j"))
    return got.select(*[c for c in docs.columns if c != value], F.inline(F.arrays_zip(*[F.col("j").getField(n).alias(n) for n in (times, *names)])))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event registry (date_start, date_end, ...), dates inclusive; an end before its start raises."""
    d = spark.read.csv(path, header=True, schema="date_start date, date_end date, event_type string, event_name string, event_scope string, location string, source_url string, source_confidence string, notes string")
    return d.withColumn("date_end", F.when(F.col("date_end") < F.col("date_start"), F.raise_error(F.lit("an event ends before it starts")).cast("date")).otherwise(F.col("date_end")))


# The hourly fields of a weather file.
WEATHER = ("temperature_2m", "relative_humidity_2m", "precipitation", "rain", "snowfall", "weather_code", "cloud_cover", "wind_speed_10m", "wind_gusts_10m")


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Hourly rows (ts, WEATHER, grid place) of JSON files of columns; a field that is missing or null throughout raises."""
    raw = spark.read.text(path, wholetext=True)
    grid = "latitude double, longitude double, elevation double"
    g = F.from_json("value", grid)
    raw = raw.select("value", *[g[a].alias(f"source_grid_{b}") for a, b in (("latitude", "latitude"), ("longitude", "longitude"), ("elevation", "elevation_m"))])
    d = json_columns(raw, "value", "hourly", list(WEATHER))
    known = d.agg(*[F.count(c).alias(c) for c in WEATHER]).first()
    empty = [c for c in WEATHER if not known[c]]
    if empty:
        raise ValueError(f"no values of {', '.join(empty)} in the weather files")
    return d.withColumn("ts", F.col("time").cast("timestamp_ntz")).drop("time")


def read_policy(spark: SparkSession, path: str, columns: dict[str, str], country: str, jurisdiction: str = "NAT_TOTAL") -> DataFrame:
    """(date, columns' new names as double) of one country from a wide CSV, of which only these columns are parsed. The last
    row of a date wins; what is no number is null; what is no date raises."""
    raw = spark.read.csv(path, header=True).where((F.col("CountryCode") == country) & (F.col("Jurisdiction") == jurisdiction))
    d = raw.select(F.to_date("Date", "yyyyMMdd").alias("date"), F.monotonically_increasing_id().alias("__at"), *[F.col(f"`{a}`").try_cast("double").alias(b) for a, b in columns.items()])
    return d.groupBy("date").agg(F.max_by(F.struct(*columns.values()), "__at").alias("r")).select("date", "r.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_months(fact: DataFrame, path: str) -> None:
    """Facts by year_month; months that fact has are replaced, others stay. The commit protocol makes it atomic."""
    fact.write.partitionBy("year_month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def json_records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
