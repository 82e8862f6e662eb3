"""SpotSigs document fingerprints: chains of content words after common-word anchors, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Common words of English, French, German and Spanish prose; a bar stands for the rule of a table.
ANCHORS = (
    "the of and to in is it that for was on with as are be this by not or at from an a "
    "de la le les et des un une du en est que qui pour dans ce pas sur par au ou avec son il elle "
    "der die das und ist von zu mit den nicht ein eine auf dem im als sich auch für "
    "el los las y se del al no lo una por con su para es como |"
).split()
#: Deleted before words are cut: ASCII punctuation but the bar.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"
SPACES = "\t\n\r\x0b\x0c"


def signatures(text: Column) -> Column:
    """The sorted distinct signatures (32-bit hashes) of a text: for every content word right after an anchor, the anchor,
    that word and the next content word. The text's start is an anchor too, so a text with a content word has at least one
    signature. Of several anchors in a row the last counts. Null, empty and all-anchor texts have none."""
    plain = F.translate(F.translate(F.lower(F.coalesce(text, F.lit(""))), SPACES, " " * len(SPACES)), MARKS, "")
    words = F.filter(F.split(plain, " "), lambda x: x != "")

    def chains(w: Column) -> Column:
        placed = F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        content = F.filter(placed, lambda s: ~s["x"].isin(ANCHORS))

        def each(c: Column) -> Column:
            def chain(s: Column, j: Column) -> Column:
                before = F.when(j == 0, F.lit(-1)).otherwise(F.get(c, j - 1)["i"])
                anchor = F.when(s["i"] == 0, F.lit("^")).otherwise(F.get(w, s["i"] - 1))
                return F.when((j == 0) | (s["i"] - before > 1), F.hash(anchor, s["x"], F.get(c, j + 1)["x"]))

            return F.array_compact(F.transform(c, chain))

        return common.let(content, each)

    return F.sort_array(F.array_distinct(common.let(words, chains)))


def fingerprint(sigs: Column) -> Column:
    """Signatures as a string: eight hexadecimal digits each, in order; equal sets have equal strings."""
    return F.lower(F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets, from 0 to 1; two empty sets are alike, an empty and another are not."""
    shared = F.size(F.array_intersect(a, b))
    together = F.size(a) + F.size(b) - shared
    return F.when(together == 0, F.lit(1.0)).otherwise(shared / together)


#: Bytes of text that a task takes to find next documents, about: the number of tasks grows with the input. Each has so
#: many ranges of ids, so that tasks are of like size although ranges are dealt by a hash.
TASK_BYTES, RANGES = 64 << 20, 8


def _place(heads: list[int], id_col: str) -> Column:
    """How many of the heads are not below the id, by looking at every so many heads first and then between two of these."""
    down = sorted(heads, reverse=True)
    step = math.isqrt(len(down)) or 1
    array = lambda x: "array(" + ", ".join(f"{h}L" if h > -(1 << 63) else "CAST('-9223372036854775808' AS BIGINT)" for h in x) + ")"
    above = lambda a: f"size(filter({a}, h -> h >= `{id_col}`))"
    inner = f"CASE WHEN k > 0 THEN (k - 1) * {step} + {above(f'slice({array(down)}, (k - 1) * {step} + 1, {step})')} ELSE 0 END"
    return F.expr(common.let_sql(above(array(down[::step])), "k", inner))


def with_next(docs: DataFrame, id_col: str, carry: list[str], tasks: int) -> DataFrame:
    """docs with `next`, a struct of the carried columns of the next row in descending id; after the last comes the first.

    Approximate quantiles of the ids cut them into at most RANGES * tasks ranges of like size, each begun by an id that exists;
    a row that begins a range is sent to the range before as well, so every window has its own range alone and only
    border rows move twice. Equal ids are in the order of the carried columns; rows without an id come last. Rows of one
    id, and those without, are in one range: ids are meant to be keys. Columns begun with two underscores are used meanwhile.
    """
    ranges = RANGES * tasks
    steps = [k / ranges for k in range(ranges)]
    got = docs.agg(F.percentile_approx(id_col, steps, max(10_000, 20 * ranges)).alias("q"), F.max(id_col).alias("top")).first()
    heads = sorted({*(got["q"] or []), *([got["top"]] if got["top"] is not None else [])}) or [0]
    last = len(heads)
    own = F.when(F.col(id_col).isNull(), F.lit(last)).otherwise(F.greatest(F.lit(1), _place(heads, id_col)))
    at = lambda b, ghost: F.struct(b.alias("b"), F.lit(ghost).alias("ghost"))
    twice = F.array(at(F.col("__own"), 0), at(F.when(F.col("__own") > 1, F.col("__own") - 1).otherwise(F.lit(last)), 1))
    rows = docs.withColumn("__own", own).withColumn("__at", F.explode(F.when(F.col(id_col).isin(heads), twice).otherwise(F.array(at(F.col("__own"), 0)))))
    rows = rows.withColumn("__b", F.col("__at.b")).withColumn("__ghost", F.col("__at.ghost")).drop("__at", "__own").repartition(tasks, "__b")
    order = Window.partitionBy("__b").orderBy(F.col("__ghost"), F.col(id_col).desc_nulls_last(), *carry)
    return rows.withColumn("next", F.lead(F.struct(*carry)).over(order)).where("__ghost = 0").drop("__b", "__ghost")


def compared(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: id, text, sigs, next (text, sigs), edited (the text whose last third is replaced by the start of the
    next document), edited_sigs and n_chars. A null text is empty; a table of one row is its own next, an empty one has no
    rows. Of rows with equal ids that with the lesser text comes first. Other columns are dropped, so none can clash."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES), 1)
    d = with_next(d.withColumn("sigs", signatures(F.col("text"))), "id", ["text", "sigs"], n)
    d = d.withColumn("next", F.coalesce("next", F.struct("text", "sigs"))).withColumn("n_chars", F.length("text"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    return d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - k), F.substring(F.col("next.text"), F.lit(1), k))).withColumn("edited_sigs", signatures(F.col("edited")))


def similar(docs: DataFrame, threshold: float = 0.44, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of equal fingerprints whose likeness reaches the threshold, and membership (id, rep).

    Sets are partitioned by length into bands so wide that similar sets are in the same or in neighbouring ones; within
    them an inverted index over each set's rarest signatures gives the pairs, the lengths prune them, and only those left
    are intersected. Texts without signatures are in no pair and their own rep.
    """
    s = docs.select(F.col(id_col).alias("id"), signatures(F.col(text).cast("string")).alias("s"))
    reps = s.where("size(s) > 0 AND id IS NOT NULL").groupBy("s").agg(F.min("id").alias("rep"))
    members = s.join(reps, "s", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    sets = reps.select("rep", "s", F.size("s").alias("n"), F.floor(F.log(F.size("s")) / math.log(1 / threshold)).alias("band"))
    each = sets.select("rep", "n", "band", F.explode("s").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    kept = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    alone = each.join(often, "t", "left_anti").groupBy("rep").agg(F.count("*").alias("alone"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("f", "t"))
    index = each.join(often, "t").join(alone, "rep", "left").withColumn("p", place + F.coalesce("alone", F.lit(0))).where(F.col("p") <= kept).select("rep", "n", "band", "t")
    a = index.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "t")
    b = index.select(F.col("rep").alias("y"), F.col("n").alias("ny"), "band", "t")
    near = a.join(b, ["band", "t"]).where((F.col("x") != F.col("y")) & (F.col("nx") >= threshold * F.col("ny")) & (F.col("ny") >= threshold * F.col("nx")))
    near = near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    left, right = sets.select(F.col("rep").alias("x"), F.col("s").alias("a")), sets.select(F.col("rep").alias("y"), F.col("s").alias("b"))
    return near.join(left, "x").join(right, "y").withColumn("likeness", likeness(F.col("a"), F.col("b"))).where(F.col("likeness") >= threshold).select("x", "y", "likeness"), members


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: the fingerprints of its text and of the edited text, and how alike they are.

    A null or empty text has an empty fingerprint, which is like other empty ones (1.0) and no other (0.0)."""
    d = compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
    )
