"""Quality of channels and source months, and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .line import free_name


def channels(readings: DataFrame, operational: int = 100) -> DataFrame:
    """Per (site, channel) of readings (site, channel, value): observations, finite, invalid, zero, positive, volume, rates,
    and the operational flag."""
    v = F.col("value")
    g = readings.groupBy("site", "channel").agg(F.count("*").alias("observations"), F.count(v).alias("finite"), F.count_if(v.isNull()).alias("invalid"), F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("positive"), F.coalesce(F.sum(v), F.lit(0)).cast("long").alias("volume"))
    return g.withColumns({"finite_rate": F.col("finite") / F.col("observations"), "positive_rate": F.col("positive") / F.col("observations"), "operational": F.col("positive") >= operational})


def source_months(records: DataFrame, per_day: int, start: str, end: str, complete: float = 0.8) -> DataFrame:
    """Every month from start to end (firsts of months): timestamps seen and expected, records, sites, and a status of
    Missing, Partial or Complete. records: (ts, site, value)."""
    m = records.groupBy(F.to_date(F.date_trunc("MONTH", "ts")).alias("date")).agg(F.count_distinct("ts").alias("timestamps"), F.count("*").alias("records"), F.count("value").alias("valid_records"), F.count_distinct("site").alias("sites"))
    months = records.sparkSession.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', INTERVAL 1 MONTH)")).alias("date"))
    d = months.join(m, "date", "left").withColumn("expected", S.expected_intervals(F.col("date"), per_day)).withColumn("coverage", F.coalesce(F.col("timestamps"), F.lit(0)) / F.col("expected"))
    return d.withColumn("status", F.when(F.col("timestamps").isNull(), "Missing").when(F.col("coverage") < complete, "Partial").otherwise("Complete")).withColumn("year_month", S.month(F.col("date"))).drop("date")


def site_records(records: DataFrame) -> DataFrame:
    """(site, records): how many records, of whatever channels, each site has. records: (site, ...), a row each."""
    return records.groupBy("site").agg(F.count("*").alias("records"))


def source_files(records: DataFrame, per_day: int) -> DataFrame:
    """An audit of each file: timestamps seen and expected in the month of its first one, their share, records, those with a
    volume, sites, first and last timestamp. records: (source_file, ts, site, value)."""
    g = records.groupBy("source_file").agg(
        F.count_distinct("ts").alias("timestamps"), F.count("*").alias("records"), F.count("value").alias("normalized_records"), F.count_distinct("site").alias("sites"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    g = g.withColumn("source_month", S.month(F.col("first_ts"))).withColumn("expected", S.expected_intervals(F.to_date("first_ts"), per_day))
    return g.withColumn("coverage", F.col("timestamps") / F.col("expected"))


def missing_months(spine: DataFrame, observed: DataFrame) -> DataFrame:
    return spine.join(observed.select("year_month").distinct(), "year_month", "left_anti")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """One row: how many rows repeat a key that was there before."""
    return df.groupBy(*key).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_keys"))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: nulls of each column and rows with any."""
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNull()
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns], F.count_if(some).alias("rows_with_missing"))


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, with an error when it is run if a key repeats: the check that a join meets each row once.

    The check is part of the plan: rows come together by their key, as the join needs them anyway, and are counted on the way;
    there is no job of its own."""
    rest = [c for c in df.columns if c not in key]
    k, row = free_name(df, "k"), free_name(df, "row")
    g = df.groupBy(*key).agg(F.count("*").alias(k), F.first(F.struct(*rest) if rest else F.lit(None)).alias(row))
    once = F.when(F.col(k) == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"repeated key {key}: "), F.to_json(F.struct(*key)))).cast("boolean"))
    return g.where(once).select(*[F.col(c) if c in key else F.col(row)[c].alias(c) for c in df.columns])
