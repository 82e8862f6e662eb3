"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the groups its links form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum
from .components import components

#: Near-duplicate stages: words of a shingle and similarity in hundredths. The query op1 has its own.
SHINGLE, PERCENT = 5, 80
#: Longest prefix extension that a document may choose.
LEVELS = 6
#: Buckets of the frequency sketch (one count array of 4 * 2**18 bytes for each task and for the driver).
SKETCH_LOG2, SKETCH_BLOCKS = 18, 32
KEYS, AGREE = 8, 5
#: Live shingles that a posting carries along, so that two documents meet once and not at each shingle they share.
HEAD = 12

_SALTS = np.random.default_rng(7).integers(1, 1 << 63, KEYS + 2, dtype=np.uint64) | np.uint64(1)


def profile(docs: DataFrame, id_col: str, text: str, n: int) -> tuple[DataFrame, str]:
    """One scan: for each row (id, n, f1, f2, keys), the size, a 128-bit hash and KEYS minima of its shingle set; and for
    each task its part of the frequency sketch (block, sketch) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_LOG2, np.uint32)
        for b in batches:
            for lo, hi, counts, h in textnum.FOLDED.blocks(b.column(1)):
                rows = hi - lo
                size, f1, f2, keys = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.zeros((rows, KEYS), np.uint64)
                for r, u in enumerate(textnum.row_shingles(h, counts, n)):
                    if len(u):
                        size[r] = len(u)
                        f1[r], f2[r] = textnum.mix(u * _SALTS[KEYS]).sum(), textnum.mix(u + _SALTS[KEYS + 1]).sum()
                        keys[r] = [(u * s).min() for s in _SALTS[:KEYS]]
                        np.add.at(sketch, (u >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, rows), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), common.long_lists(keys.ravel(), np.full(rows, KEYS)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names=["id", "n", "f1", "f2", "keys", "block", "sketch"],
                )
        if sketch.any():
            k = SKETCH_BLOCKS
            parts = [x.tobytes() for x in np.split(sketch, k)]
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * 4 + [pa.nulls(k, pa.list_(pa.int64())), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=["id", "n", "f1", "f2", "keys", "block", "sketch"])

    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return common.write_table(df.mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>, block int, sketch binary"), "profile")


def frequencies(profiles: DataFrame) -> np.ndarray:
    """The tasks' sketches added up, block by block: 2**SKETCH_LOG2 counts, whatever the input's size."""
    width = (1 << SKETCH_LOG2) // SKETCH_BLOCKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total.setdefault(k, np.zeros(width, np.int64)).__iadd__(np.frombuffer(s.as_buffer(), np.uint32))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sketch"])

    parts = profiles.where("block IS NOT NULL").select("block", "sketch").repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, sketch binary").toArrow()
    out = np.zeros(1 << SKETCH_LOG2, np.int64)
    for k, s in zip(parts["block"].to_pylist(), parts["sketch"], strict=True):
        out[k * width : (k + 1) * width] += np.frombuffer(s.as_buffer(), np.int64)
    return out


def adaptive_prefix(u: np.ndarray, counts: np.ndarray, floor: int, percent: int) -> tuple[int, np.ndarray]:
    """The level that a set chooses, and its rarest shingles up to the longest prefix, rarest first.

    A partner shares at least o = ceil(percent/100 * size) shingles, so the first size - o + l in a common order hold at
    least l shared ones, for each l up to o. Longer prefixes meet more partners but ask more of them: with S(l) the
    summed frequencies of the l-prefix, S(l) postings are read and at most S(l) / l partners are left to verify.
    """
    n = len(u)
    o = -(-percent * n // 100)
    most = min(LEVELS, o)
    c = counts[(u >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)]
    first = np.lexsort((u, c))[: n - o + most]
    cost = np.cumsum(np.maximum(c[first] - floor, 1))[n - o :]
    level = int(np.argmin(cost * (1 + max(1.0, n / 64) / np.arange(1, most + 1)))) + 1
    return level, u[first]


def prefixes(docs: DataFrame, id_col: str, text: str, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(id, n, level, tokens) for each row with shingles."""
    held = docs.sparkSession.sparkContext.broadcast((counts, int(np.median(counts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, floor = held.value
        for b in batches:
            for lo, hi, words, h in textnum.FOLDED.blocks(b.column(1)):
                size, level, lists = [], [], []
                for u in textnum.row_shingles(h, words, n):
                    got = adaptive_prefix(u, counts, floor, percent) if len(u) else (0, u)
                    size.append(len(u))
                    level.append(got[0])
                    lists.append(got[1])
                lengths = np.array([len(x) for x in lists], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(level, pa.int32()), common.long_lists(np.concatenate([h[:0], *lists]), lengths)], names=["id", "n", "level", "tokens"])

    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return df.mapInArrow(run, "id long, n long, level int, tokens array<long>").where("n > 0 AND id IS NOT NULL")


def verified(docs: DataFrame, id_col: str, text: str, n: int, percent: int, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) whose whole shingle sets reach the similarity, with `shared` and `together` (sizes of
    intersection and union), written. pairs is a written table.

    Sets are made again for the documents in pairs alone: a fixed-size bitmap lets most others go before the shuffle,
    the join on ids the rest.
    """
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    held = docs.sparkSession.sparkContext.broadcast(common.bitmap(ids, "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for b in batches:
            b = b.filter(pa.array(common.in_bitmap(words, b.column(0).to_numpy(zero_copy_only=False))))
            for lo, hi, counts, h in textnum.FOLDED.blocks(b.column(1)):
                lists = list(textnum.row_shingles(h, counts, n))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), common.long_lists(np.concatenate([h[:0], *lists]), np.array([len(x) for x in lists], np.int64))], names=["id", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.small(batches):
            shared, together = [], []
            for a, c in zip(b.column(2), b.column(3), strict=True):
                p, q = (z.values.to_numpy().view(np.uint64) for z in (a, c))
                at = np.minimum(np.searchsorted(q, p), max(len(q) - 1, 0))
                k = int(np.count_nonzero(q[at] == p)) if len(q) else 0
                shared.append(k)
                together.append(len(p) + len(q) - k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int64()), pa.array(together, pa.int64())], names=["x", "y", "shared", "together"])

    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t")).where("id IS NOT NULL")
    s, at_sets = common.write_table(df.mapInArrow(sets, "id long, s array<long>"), "sets")
    a, b = s.select(F.col("id").alias("x"), F.col("s").alias("a")), s.select(F.col("id").alias("y"), F.col("s").alias("b"))
    # A document that is in very many pairs, as the centre of a star is, meets its partners in several tasks.
    by_x, by_y = common.hot_keys(pairs, ["x"]), common.hot_keys(pairs, ["y"])
    full = common.dealt(common.dealt(pairs.select("x", "y"), by_x, ["x"], "px", ["y"]), by_y, ["y"], "py", ["x"])
    full = full.join(common.repeated(a, by_x, ["x"], "px"), ["x", "px"]).join(common.repeated(b, by_y, ["y"], "py"), ["y", "py"]).select("x", "y", "a", "b")
    out, _ = common.write_table(full.mapInArrow(compare, "x long, y long, shared long, together long").where(f"100 * shared >= {percent} * together").distinct(), "links")
    common.drop_table(docs.sparkSession, at_sets)
    return out


def star_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(x, y): each class with the smallest class that has the same minima at AGREE of KEYS places, at like size.

    At most KEYS rows for a class, whatever a group's size. These pairs are only a first contraction of large groups
    of near copies, so that the join need not emit all pairs within them.
    """
    band = F.floor(F.log("n") / math.log(100 / percent))
    rows = classes.select("id", band.alias("band"), F.posexplode("keys").alias("k", "key"))
    low = rows.groupBy("band", "k", "key").agg(F.min("id").alias("y"), F.max("id").alias("z")).where("y <> z").drop("z")
    return rows.join(low, ["band", "k", "key"]).where("id <> y").groupBy(F.col("id").alias("x"), "y").agg(F.count("*").alias("c")).where(F.col("c") >= AGREE).select("x", "y")


def candidates(prefix: DataFrame, percent: int, path: str) -> DataFrame:
    """(x, y) that may be similar and are in different components so far; prefix: (id, n, level, tokens, c), the table at path, which
    goes as soon as what is live in it has been written.

    A shingle that one component alone has in its prefixes is dropped; a document with more of these than a partner may
    lack, or whose other shingles all come after so many, has no partner outside its component and goes too. With fewer,
    the number says nothing of a partner's size, as a longer document may hold such shingles behind its own prefix. A
    posting's place does, for the first shingle that two documents share: both miss all before it, and `top` is the size
    that a partner may have at most. For the others, pairs of components are formed first and then
    the documents of each that have the shingle, so documents of one component never meet. The larger of two documents
    says how many shared shingles of the prefixes it takes (`level`); what stands behind the last shared one bounds the
    rest of the overlap.
    """
    spark = prefix.sparkSession
    spread = prefix.select(F.explode("tokens").alias("token"), "c").groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("token")
    spread, at_spread = common.write_table(spread, "tokens")
    held = spark.sparkContext.broadcast(common.bitmap(spread, "token"))

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words = held.value
        for b in common.small(batches):
            lists = b.column(4)
            flat = lists.flatten().to_numpy()
            lengths = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            alive = common.in_bitmap(words, flat)
            size = b.column(1).to_numpy()
            spare = size - -(-percent * size // 100)
            dead = np.cumsum(~alive)
            before = dead - np.repeat(np.concatenate([[0], dead])[np.cumsum(lengths) - lengths], lengths)
            gone = np.bincount(row, ~alive, len(lengths)).astype(np.int64)
            keep = np.flatnonzero(alive & (before <= spare[row]) & (gone <= spare)[row])
            yield b, flat[keep], row[keep], place[keep], np.bincount(row[keep], minlength=len(lengths))

    def by_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, token, row, place, k in live(batches):
            nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            heads = common.long_lists(token[nth < HEAD], np.minimum(k, HEAD))
            n = b.column(1).to_numpy()[row]
            top = (100 + percent) * (n - place) // percent - n
            post = np.flatnonzero(100 * top >= percent * n)
            which = pa.array(row[post])
            yield pa.RecordBatch.from_arrays([b.column(j).take(which) for j in range(4)] + [pa.array(token[post]), pa.array(top[post]), pa.array(k).take(which), heads.take(which)], names=["id", "n", "level", "c", "token", "top", "k", "head"])

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, token, _, place, k in live(batches):
            some = pa.array(k > 0)
            yield pa.RecordBatch.from_arrays([b.column(j).filter(some) for j in range(3)] + [common.long_lists(token, k).filter(some), common.long_lists(place.astype(np.int64), k).filter(some)], names=["id", "n", "level", "live", "places"])

    source = prefix.select("id", "n", "level", "c", "tokens")
    rows = source.mapInArrow(by_shingle, "id long, n long, level int, c long, token long, top long, k long, head array<long>")
    rows, at_rows = common.write_table(rows.join(spread, "token", "left_semi"), "postings")
    whole, at_whole = common.write_table(source.mapInArrow(by_document, "id long, n long, level int, live array<long>, places array<long>"), "live")
    common.drop_table(spark, path)
    common.drop_table(spark, at_spread)
    per = rows.groupBy("token", "c").agg(F.count("*").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("top").alias("top"))
    names = ("c", "d", "lo", "hi", "top")
    a, b = (per.select("token", *[F.col(v).alias(f"{v}{j}") for v in names]) for j in (1, 2))
    per, at_per = common.write_table(per, "components")
    hot = common.hot_keys(per, ["token"])
    # The component with fewer documents on the left: that many rows per pair of components are made, not their product.
    fewer = F.expr("d1 < d2 OR (d1 = d2 AND c1 < c2)")
    met = common.dealt(a, hot, ["token"], "part", ["c1"]).join(common.repeated(b, hot, ["token"], "part"), ["token", "part"]).where(fewer & F.expr(f"100 * hi2 >= {percent} * lo1 AND 100 * hi1 >= {percent} * lo2 AND lo2 <= top1 AND lo1 <= top2")).select("token", "c1", "c2")
    side = lambda j: rows.select("token", F.col("c").alias(f"c{j}"), *[F.col(v).alias(f"{v}{j}") for v in ("id", "n", "level", "top", "k", "head")])
    need = F.when(F.expr("n1 > n2 OR (n1 = n2 AND id1 > id2)"), F.col("level1")).otherwise(F.col("level2"))
    fits = F.expr(f"100 * n2 >= {percent} * n1 AND 100 * n1 >= {percent} * n2 AND n2 <= top1 AND n1 <= top2")
    heads = F.array_intersect("head1", "head2")
    # Of the shingles that both documents have among their first HEAD, one alone makes the pair; if these are all their
    # live shingles, so many as are needed must be shared.
    once = (F.size(heads) == 0) | (F.element_at(heads, 1) == F.col("token"))
    enough = (F.greatest("k1", "k2") > HEAD) | (F.size(heads) >= need)
    m = met.join(side(1), ["token", "c1"]).join(side(2), ["token", "c2"]).where(fits & once & enough).select(F.greatest("id1", "id2").alias("x"), F.least("id1", "id2").alias("y")).distinct()
    m, at_met = common.write_table(m, "met")
    common.drop_table(spark, at_per)
    common.drop_table(spark, at_rows)
    of = lambda v, j: whole.select(F.col("id").alias(v), *[F.col(w).alias(f"{w}{j}") for w in ("n", "level", "live", "places")])
    by_x, by_y = common.hot_keys(m, ["x"]), common.hot_keys(m, ["y"])
    m = common.dealt(common.dealt(m, by_x, ["x"], "px", ["y"]), by_y, ["y"], "py", ["x"])
    shared = F.array_intersect("live1", "live2")
    left = lambda j: F.col(f"n{j}") - F.element_at(f"places{j}", F.array_position(f"live{j}", F.element_at("shared", -1)).cast("int"))
    need = F.when(F.expr("n1 >= n2"), F.col("level1")).otherwise(F.col("level2"))
    both = m.join(common.repeated(of("x", 1), by_x, ["x"], "px"), ["x", "px"]).join(common.repeated(of("y", 2), by_y, ["y"], "py"), ["y", "py"])
    got = both.withColumn("shared", shared).where(F.size("shared") >= need)
    got = got.where((100 + percent) * (F.size("shared") - 1 + F.least(left(1), left(2))) >= percent * (F.col("n1") + F.col("n2"))).select("x", "y")
    out, _ = common.write_table(got.distinct(), "candidates")
    common.drop_table(spark, at_met)
    common.drop_table(spark, at_whole)
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links of a Jaccard self-join over sets of n-word shingles, between classes of equal sets, and membership.

    Returns (members, links). members has one row per input row: id, n (distinct shingles), rep (smallest id with an
    equal set; null without an id or words). links has (x, y, shared, together) between representatives: every pair
    of similar classes that are not joined otherwise is in it, so its components are those of all links; copies are
    not expanded into pairs, and of a group joined already not every pair is given. Words are runs of non-space bytes
    with A-Z lower-cased; a text of fewer than n words is one shingle; null and empty texts have none and link with
    nothing. Repeated rows are members of one class. Shingles are compared by 64-bit hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    profiles, _ = profile(docs, id_col, text, n)
    counts = frequencies(profiles)
    rows = profiles.where("block IS NULL")
    real = rows.where("n > 0 AND id IS NOT NULL")
    reps = real.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    reps, _ = common.write_table(reps, "classes")
    members = rows.select("id", "n", "f1", "f2").join(reps, ["n", "f1", "f2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"))
    only = reps.select(F.col("rep").alias("id"))
    classes = real.select("id", "n", "keys").join(only, "id", "left_semi").dropDuplicates(["id"])
    pairs, at_pairs = common.write_table(star_pairs(classes, percent), "stars")
    stars = verified(docs, id_col, text, n, percent, pairs)
    # One hop is enough here: a component that is found only in part merely costs candidates.
    low = stars.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("c"))
    hop = low.select(F.col("id").alias("c"), F.col("c").alias("c_next"))
    known = low.join(hop, "c", "left").select("id", F.coalesce("c_next", "c").alias("c"))
    prefix = prefixes(docs, id_col, text, n, percent, counts).join(only, "id", "left_semi").join(known, "id", "left").withColumn("c", F.coalesce("c", "id"))
    prefix, at_prefix = common.write_table(prefix, "prefixes")
    common.drop_table(spark, at_pairs)
    found = candidates(prefix, percent, at_prefix)
    links = stars.unionByName(verified(docs, id_col, text, n, percent, found)).distinct()
    links, _ = common.write_table(links, "links")
    return members, links


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n, component) for each input row: component is the smallest id reachable by links, its own without any."""
    members, links = ngram_join(docs, id_col, text, n, percent)
    comp = components(links)
    return members.join(comp, members["rep"] == comp["node"], "left").select("id", "n", F.coalesce("component", "rep", "id").alias("component"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: that with the smallest id, once. Rows without an id or without words stay.

    Of rows that repeat an id with words one stays, whichever. Other columns pass through, whatever their names; no rows
    give no rows. Texts are compared whole."""
    with common.dropping() as kept:
        g = grouped(docs, id_col, text, n, percent).where("n > 0 AND id <> component").select(F.col("id").alias(id_col)).distinct()
        g, at = common.write_table(g, "copies")
        kept.append(at)
    rest = common.without_ids(docs, g, id_col)
    twice, _ = common.write_table(rest.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("k")).where("k > 1").select(id_col), "twice")
    if twice.isEmpty():
        return rest
    again = rest.join(twice, id_col, "left_semi")
    blank = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    return common.without_ids(rest, twice, id_col).unionByName(again.where(blank)).unionByName(again.where(~blank).dropDuplicates([id_col]))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: the size of its set of three-word shingles and the smallest id of its group at 0.9.

    A null or empty text has no shingles and is its own group; equal texts are in one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grouped(docs, n=3, percent=90).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
