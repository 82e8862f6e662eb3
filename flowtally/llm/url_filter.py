"""URL filters: dated list entries become validity intervals, and captures are judged as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The host of a URL: after the scheme and a user, before port, path, query and fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
EPOCH = "2024-01-01 00:00:00"
MINUTES = 525_600


def host_of(url: Column) -> Column:
    """Lower-cased host without a final dot; '' for null and for what is no URL with a scheme."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def suffixes(host: Column) -> Column:
    """A host and its parent domains, longest first; none for ''."""
    parts = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.when(host != "", names).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (key, listed_at, listed: true for put on, false for taken off) as (key, valid_from, valid_to) of the
    stretches in which the key is on the list; valid_to is exclusive, null while it lasts.

    An entry holds until the key's next date. Of several on one date, taking off wins; repeats change nothing; null keys or
    dates are no entries.
    """
    e = entries.where("key IS NOT NULL AND listed_at IS NOT NULL AND listed IS NOT NULL").groupBy("key", "listed_at").agg(F.bool_and("listed").alias("listed"))
    by = Window.partitionBy("key").orderBy("listed_at")
    return e.withColumn("valid_to", F.lead("listed_at").over(by)).where("listed").select("key", F.col("listed_at").alias("valid_from"), "valid_to")


def as_of(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with host, blocked, n_active (entries for the host or a parent domain that held at fetch time) and entry
    (the longest key of those; null if none). Columns of those names are replaced; no capture is left out.

    Entries are joined to the distinct hosts, each host's intervals gathered (as many as the list has for its domains), and
    these joined back to the captures, where a host with very many captures is split. Null URLs or times are never blocked,
    nor is a URL without a scheme, however long. Repeated captures are judged one by one; empty tables give no rows, or
    rows that nothing blocks.
    """
    new = ("host", "blocked", "n_active", "entry")
    mine = [k for k in captures.columns if k not in new]
    gathered, active = common.free_names([*mine, *new], "gathered", "active")
    c = captures.select(*mine).withColumn("host", host_of(F.col(url)))
    keys = c.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
    lists = keys.join(intervals(entries), "key").groupBy("host").agg(F.collect_list(F.struct(F.length("key").alias("n"), "key", "valid_from", "valid_to")).alias(gathered))
    lists, _ = common.write_table(lists, "lists")
    j = common.split_join(c, lists, ["host"], "left", by=[url, at])
    on = F.filter(gathered, lambda x: (x["valid_from"] <= F.col(at)) & (x["valid_to"].isNull() | (F.col(at) < x["valid_to"])))
    j = j.withColumn(active, F.when(F.col(at).isNotNull() & F.col(gathered).isNotNull(), on))
    return j.select(*c.columns, F.coalesce(F.size(active) > 0, F.lit(False)).alias("blocked"), F.when(F.col(active).isNotNull(), F.size(active)).otherwise(0).cast("long").alias("n_active"), F.array_max(active)["key"].alias("entry"))


def blocked_out(captures: DataFrame, entries: DataFrame, **how) -> DataFrame:
    """captures that no entry held against when they were fetched."""
    return as_of(captures, entries, **how).where("NOT blocked").select(*captures.columns)


def _dial(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a list made from their hosts: no table has fetch times or a list, so both follow from ids and names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    start = F.lit(EPOCH).cast("timestamp_ntz")
    day = lambda n: F.timestamp_add("DAY", n.cast("int"), start)
    captures = pages.withColumn("fetched_at", F.timestamp_add("MINUTE", (F.col("page_id") * 7919 % MINUTES).cast("int"), start))
    names = pages.select(F.explode(F.slice(suffixes(host_of(F.col("url"))), 1, 2)).alias("key")).distinct().withColumn("d", _dial(F.col("key"))).where("d % 3 = 0")
    dates = F.array(
        F.struct(day(F.col("d") % 200).alias("listed_at"), F.lit(True).alias("listed")),
        F.when(F.col("d") % 2 == 0, F.struct(day(F.col("d") % 200 + 60).alias("listed_at"), F.lit(False).alias("listed"))),
        F.when(F.col("d") % 5 == 0, F.struct(day(F.col("d") % 200 + 120).alias("listed_at"), F.lit(True).alias("listed"))),
    )
    entries = names.select("key", F.explode(F.array_compact(dates)).alias("e")).select("key", "e.*")
    return as_of(captures, entries).select("page_id", "url", "host", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "blocked", "n_active", "entry")


OP6_SQL = r"""
WITH c AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes((page_id * 7919 % 525600)::INT) AS fetched_at FROM pages),
p AS (SELECT DISTINCT host, string_split(host, '.') AS parts FROM c WHERE host <> ''),
k AS (SELECT host, i, array_to_string(parts[i:], '.') AS key FROM p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
n AS (SELECT DISTINCT key, ('0x' || substr(md5(key), 1, 8))::BIGINT AS d FROM k WHERE i <= 2),
e AS (SELECT key, (d % 200)::INT AS day, true AS listed FROM n WHERE d % 3 = 0
  UNION ALL SELECT key, (d % 200 + 60)::INT, false FROM n WHERE d % 3 = 0 AND d % 2 = 0
  UNION ALL SELECT key, (d % 200 + 120)::INT, true FROM n WHERE d % 3 = 0 AND d % 5 = 0),
v AS (SELECT key, listed, TIMESTAMP '2024-01-01 00:00:00' + to_days(day) AS a, TIMESTAMP '2024-01-01 00:00:00' + to_days(lead(day) OVER (PARTITION BY key ORDER BY day)) AS z FROM e),
h AS (SELECT c.page_id, count(*) AS n_active, arg_max(k.key, length(k.key)) AS entry FROM c JOIN k ON k.host = c.host JOIN v ON v.key = k.key
  WHERE v.listed AND v.a <= c.fetched_at AND (v.z IS NULL OR c.fetched_at < v.z) GROUP BY c.page_id)
SELECT c.page_id, c.url, c.host, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, h.page_id IS NOT NULL AS blocked, coalesce(h.n_active, 0)::BIGINT AS n_active, h.entry
FROM c LEFT JOIN h ON h.page_id = c.page_id
"""
