"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies, drawn systematically along the sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Targets are a share of all words, in hundredths, and stop at this many times the words of their source.
SHARE_PERCENT = 150
MOST = 2
SEED = "mix"


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the number of their words as `size` (null text: 0); a column of that name is replaced."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, rate; sizes: (source, size), each m times where there is a column m.

    Sources in code-point order, null last, get the weights in turn. Together they are given percent/100 of all words
    (at most `most` times all words); a target stops at `most` times its source, and what is over is dealt anew by
    weight until no target is above. That is filling vessels to a common level: ordered by the level at which each is
    full, those are full whose level is not above what the rest would reach. A source without words has rate 0.
    Works on one row per source; documents are summed per source before they are shuffled.
    """
    words = F.col("size") * F.col("m") if "m" in sizes.columns else F.col("size")
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(words).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), place.cast("int") + 1).cast("long")
    every = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.col("goal") - F.col("full_before")) / F.col("weight_left"))
    goal = F.least(F.sum("source_size").over(every) * F.lit(percent / 100.0), F.sum("source_size").over(every) * F.lit(float(most)))
    t = (
        per.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("full_at", F.col("cap").cast("double") / F.col("w"))
        .withColumn("goal", goal)
        .withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", level)
    )
    # The first that is not full sets the level of all that follow: full ones come first, and later levels only fall.
    rest = F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(every)
    target = F.when(F.col("full_at") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.least(rest * F.col("w"), F.col("cap").cast("double")))
    return t.withColumn("target", target).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def draw(key, seed: str = SEED):
    """A number in [0, 1) that depends on the seed and the key alone (52 bits of an MD5)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(16**13)


def size_classes(sizes: DataFrame) -> DataFrame:
    """(source, size, m): how many documents each source has of each size, summed in every task before they are shuffled."""
    return sizes.groupBy(F.col("source"), "size").agg(F.count("*").alias("m"))


def shares(classes: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """classes with `share`: how many of the class's m documents get one more copy, divided by m.

    A source's documents lie on a line in order of size, those of every other size on the way up and the rest on the way
    down, and a document takes the fraction of the rate of it. Marks stand one apart from an offset in [0, 1) on, drawn by a hash
    of the seed and the source alone: a class gets as many more copies as marks lie on its part. Whatever the sizes are, the
    mean over offsets is m times the fraction, so every document's probability is the fraction; as small and large take turns
    both ways, sums come near the target. A class of one is decided by the mark, one of several by each document's own draw.
    Windows are over the sizes of one source, not over its documents.
    """
    none = F.col("source").isNull()
    key, is_none = F.coalesce("source", F.lit("")).alias("key"), none.alias("none")
    by = Window.partitionBy("key", "none")
    c = common.split_join(classes.select(key, is_none, "size", "m"), rates.select(key, is_none, "rate"), ["key", "none"])
    c = c.withColumn("odd", F.row_number().over(by.orderBy("size")) % 2)
    line = by.orderBy(F.desc("odd"), F.when(F.col("odd") == 1, F.col("size")).otherwise(-F.col("size")))
    c = c.withColumn("before", F.coalesce(F.sum("m").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offset = draw(F.when(F.col("none"), F.lit("none")).otherwise(F.concat(F.lit("source:"), "key")), seed)
    f = F.col("rate") - F.floor("rate")
    marks = F.floor(offset + (F.col("before") + F.col("m")) * f) - F.floor(offset + F.col("before") * f)
    return c.select("key", "none", "size", "m", (marks / F.col("m")).alias("share"))


def _with(d: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """d with the columns of small by its keys (key and none stand for the source). What is few is broadcast; otherwise keys of
    the table `hot` (keys, parts) are dealt over parts by a hash of all columns."""
    if hot is None or small.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        return common.split_join(d, small, keys, "left")
    part = common.free_names([*d.columns, *small.columns], "part")[0]
    return common.dealt(d, hot, keys, part, d.columns).join(common.repeated(small, hot, keys, part), [*keys, part], "left").drop(part)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **how) -> DataFrame:
    """docs with size, source_size, target, rate and copies: floor(rate) plus one more with the rate's fraction as probability.

    Columns of docs with those names are replaced. Rows with equal ids and sizes draw alike, those without an id as if it were
    empty. Null and empty texts have size 0; a null source is a source. Empty input gives no rows. Texts are counted whole, once
    for the targets and once here; what lies between is (source, size, number) in the shared folder.
    """
    new = ("size", "source_size", "target", "rate", "copies")
    mine = [c for c in docs.columns if c.lower() not in new]
    key, none, size, m, share = common.free_names([*docs.columns, *new], "key", "none", "words", "m", "share")
    classes, at = common.write_table(size_classes(sized(docs.select(F.col(source).cast("string").alias("source"), F.col(text).alias("text"))).select("source", "size")), "sizes")
    rates, _ = common.write_table(source_targets(classes, "source", **how), "rates")
    parts, _ = common.write_table(shares(classes, rates, seed), "shares")
    common.drop_table(docs.sparkSession, at)
    rates = rates.select(F.coalesce("source", F.lit("")).alias(key), F.col("source").isNull().alias(none), "source_size", "target", "rate")
    parts = parts.select(F.col("key").alias(key), F.col("none").alias(none), F.col("size").alias(size), F.col("m").alias(m), F.col("share").alias(share))
    # A class's documents were counted, so that hot ones are known without reading the texts once more.
    total = classes_total(parts, m)
    least = max(common.FEW_ROWS, total // max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = parts.where(F.col(m) > least).select(key, none, size, F.ceil(F.col(m) / least).cast("int").alias("parts"))
    d = sized(docs.select(*mine), text).withColumnRenamed("size", size).withColumn(key, F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn(none, F.col(source).isNull())
    d = _with(d, common.split_join(parts, rates, [key, none]), [key, none, size], hot)
    drawn = draw(F.col(id_col), seed) < F.col(share)
    return d.withColumn("copies", (F.floor("rate") + drawn.cast("int")).cast("int")).withColumnRenamed(size, "size").select(*mine, *new)


def classes_total(parts: DataFrame, m: str) -> int:
    return parts.agg(F.sum(m)).first()[0] or 0


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as many times as its copies, numbered by `copy` from 1; a column of that name is
    replaced. No documents give none."""
    return mix_plan(docs.drop("copy"), **how).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: its size, its source's size and target, and the words that the mix takes from it.

    Null texts have no words, a null source is one of its own, rows of one id and size are drawn alike; no documents give none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3]::BIGINT AS w FROM p),
t AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS full_at, (sum(source_size) OVER ())::DOUBLE * 1.5 AS goal FROM w),
u AS (SELECT *, (goal - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
      FROM t WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, max(CASE WHEN full_at > level THEN level END) OVER () AS rest FROM u),
r AS (SELECT source, source_size, CASE WHEN full_at <= level THEN cap::DOUBLE ELSE least(rest * w, cap::DOUBLE) END AS target FROM v),
x AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('mix:' || CASE WHEN source IS NULL THEN 'none' ELSE 'source:' || source END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS o FROM r),
k AS (SELECT source, size, count(*) AS m, row_number() OVER (PARTITION BY source ORDER BY size) % 2 AS odd FROM d GROUP BY source, size),
l AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY source ORDER BY odd DESC, CASE WHEN odd = 1 THEN size ELSE -size END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
s AS (SELECT l.source, l.size, x.source_size, x.target, x.rate, (floor(o + (before + m)::DOUBLE * (rate - floor(rate))) - floor(o + before::DOUBLE * (rate - floor(rate)))) / m AS share FROM l JOIN x ON x.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, d.size, source_size, target,
       d.size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < share THEN 1 ELSE 0 END) AS taken
FROM d JOIN s ON d.size = s.size AND d.source IS NOT DISTINCT FROM s.source
""".replace(' COLLATE "C"', "")
