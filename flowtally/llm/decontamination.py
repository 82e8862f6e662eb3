"""Benchmark decontamination by a positional inverted index: rarest terms first, offset-adjusted intersection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textnum

WINDOW = 10
#: Bits (as a power of two) of the bitmaps that say which terms the index holds.
TERM_LOG2 = 22


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(item, window, n, terms): every n consecutive words of each item; an item of fewer words, but not none, is one window.

    window is the hash of the word sequence; item the id as a string ('' for null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, counts, h in textnum.ALNUM.blocks(b.column(1)):
                out: list[tuple] = []
                at = 0
                for r, c in enumerate(counts.tolist()):
                    k = min(n, c)
                    if c:
                        w = textnum.grams(h[at : at + c], k).view(np.int64).tolist()
                        item = b.column(0)[lo + r].as_py()
                        out += [(item, x, k, h[at + i : at + i + k].view(np.int64)) for i, x in enumerate(w)]
                    at += c
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.list_(pa.int64()))], names=["item", "window", "n", "terms"])

    df = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("t"))
    return df.mapInArrow(run, "item string, window long, n int, terms array<long>")


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))


def term_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, freq) over all documents, for the given terms (a column `term`); terms that never occur are left out."""
    held = docs.sparkSession.sparkContext.broadcast(common.bitmap(terms, "term", TERM_LOG2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, h in textnum.ALNUM.blocks(b.column(0)):
                t, k = np.unique(h[common.in_bitmap(held.value, h.view(np.int64))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(k)], names=["term", "k"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "term long, k long").groupBy("term").agg(F.sum("k").alias("freq")).join(terms, "term", "left_semi")


def postings(docs: DataFrame, id_col: str, text: str, terms: DataFrame) -> tuple[DataFrame, str]:
    """The positional index, written to the shared folder: one row per document with its postings of the given terms.

    (id, seq, n_words, terms, places): seq is a hash of the whole word sequence and stands for the text from here on, so
    that copies are looked up once; terms[i] stands at places[i] in the document. Every input row has a row.
    """
    held = docs.sparkSession.sparkContext.broadcast(common.bitmap(terms, "term", TERM_LOG2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, counts, h in textnum.ALNUM.blocks(b.column(1)):
                keep = np.flatnonzero(common.in_bitmap(held.value, h.view(np.int64)))
                ends = np.cumsum(counts)
                row = np.searchsorted(ends, keep, "right")
                lengths = np.bincount(row, minlength=hi - lo)
                place = keep - (ends - counts)[row]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(textnum.sequence_hash(h, counts).view(np.int64)), pa.array(counts.astype(np.int64)), common.long_lists(h[keep], lengths), common.long_lists(place, lengths)], names=["id", "seq", "n_words", "terms", "places"])

    return common.write_table(_texts(docs, id_col, text).mapInArrow(run, "id long, seq long, n_words long, terms array<long>, places array<long>"), "postings")


def _anchors(queries: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(window, n, t1, o1, t2, o2): each distinct query's two rarest terms with their offsets; t2 is null for one term.

    Frequencies count all documents. Queries with a term that no document has cannot occur and are left out.
    """
    q = queries.select("window", "n", "terms").dropDuplicates(["window"])
    each = q.select("window", "n", F.posexplode("terms").alias("o", "term"))
    freq = term_counts(docs, text, each.select("term").distinct())
    known = each.join(freq, "term").withColumn("have", F.count("*").over(Window.partitionBy("window"))).where("have = n")
    rank = F.row_number().over(Window.partitionBy("window").orderBy("freq", "term", "o"))
    pick = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    return known.withColumn("r", rank).where("r <= 2").groupBy("window", "n").agg(pick(1, "term").alias("t1"), pick(1, "o").alias("o1"), pick(2, "term").alias("t2"), pick(2, "o").alias("o2"))


def _words_of(docs: DataFrame, id_col: str, text: str, seqs: DataFrame) -> DataFrame:
    """(seq, words) once for each sequence in seqs (seq, id): the id's document is read again, whole."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(common.bitmap(seqs, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(common.in_bitmap(held.value, ids) | b.column(0).is_null().to_numpy(zero_copy_only=False)))
            for lo, hi, counts, h in textnum.ALNUM.blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(textnum.sequence_hash(h, counts).view(np.int64)), common.long_lists(h, counts)], names=["id", "seq", "words"])

    got = _texts(docs, id_col, text).mapInArrow(run, "id long, seq long, words array<long>")
    return got.join(seqs, (got["seq"] == seqs["seq"]) & got["id"].eqNullSafe(seqs["id"]), "left_semi").select("seq", "words").dropDuplicates(["seq"])


def _index(docs: DataFrame, id_col: str, text: str, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors, index rows, distinct postings (term, seq, n_words, place))."""
    anchors, _ = common.write_table(_anchors(queries, docs, text), "anchors")
    terms = anchors.select(F.explode(F.array("t1", "t2")).alias("term")).where("term IS NOT NULL").distinct()
    rows, _ = postings(docs, id_col, text, terms)
    z = rows.select("seq", "n_words", F.explode(F.arrays_zip("terms", "places")).alias("z")).select(F.col("z.terms").alias("term"), "seq", "n_words", F.col("z.places").alias("place"))
    return anchors, rows, z.distinct()


def _holders(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(seq, id): for each sequence in found, one document that has it."""
    return rows.join(found.select("seq").distinct(), "seq", "left_semi").groupBy("seq").agg(F.min("id").alias("id"))


def phrase_matches(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Exact occurrences of the queries (window, n, terms) in documents.

    Returns (rows, matches): rows has (id, seq, n_words) for every input row; matches has (seq, window, n, start). For each
    query the postings of its two rarest terms are intersected after taking off their offsets; the few documents left
    are read again and every other term compared at its place. A null or empty text has no words.
    """
    anchors, rows, posts = _index(docs, id_col, text, queries)
    found, _ = common.write_table(_places(anchors, posts), "found")
    words = _words_of(docs, id_col, text, _holders(rows, found))
    matches = words.join(found, "seq").select("seq", "words", "c").mapInArrow(_compare(_occurrences, "seq", "window", "n", "start"), "seq long, window long, n int, start long")
    return rows.select("id", "seq", "n_words"), matches


def _places(anchors: DataFrame, posts: DataFrame) -> DataFrame:
    """(seq, c): for each text in which a query's two rarest terms stand as far apart as in the query, all (start, n, window).

    The queries are broadcast while they are few; of more, a frequent rarest term has its postings split.
    """
    p1 = posts.select(F.col("term").alias("t1"), "seq", "n_words", F.col("place").alias("a"))
    p2 = posts.select(F.col("term").alias("t2"), "seq", F.col("place").alias("b"))
    first = common.split_join(p1, anchors, ["t1"], by=["seq", "a"]).withColumn("start", F.col("a") - F.col("o1")).where("start >= 0 AND start + n <= n_words").select("window", "n", "t2", "seq", "start", (F.col("start") + F.col("o2")).alias("b"))
    both = first.where("t2 IS NOT NULL").join(p2, ["t2", "seq", "b"]).select("seq", "window", "n", "start")
    found = both.unionByName(first.where("t2 IS NULL").select("seq", "window", "n", "start"))
    return found.groupBy("seq").agg(F.collect_set(F.struct("start", "n", "window")).alias("c"))


def _compare(result, *names):
    """A function for mapInArrow over (seq, words, c): result(words, places that hold, as arrays) gives rows of names but seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"seq": pa.int64(), "window": pa.int64(), "n": pa.int32(), "start": pa.int64(), "n_hit": pa.int64(), "windows": pa.list_(pa.int64())}
        for b in batches:
            out: list[tuple] = []
            for seq, words, cs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                h, c = words.values.to_numpy().view(np.uint64), cs.values
                start, n, window = (c.field(k).to_numpy() for k in ("start", "n", "window"))
                holds = np.zeros(len(start), bool)
                for k in np.unique(n).tolist():
                    at = np.flatnonzero(n == k)
                    holds[at] = textnum.grams(h, k).view(np.int64)[start[at]] == window[at]
                out += [(seq, *x) for x in result(len(h), start[holds], n[holds], window[holds])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[name]) for k, name in enumerate(names)], names=list(names))

    return run


def _occurrences(size: int, start: np.ndarray, n: np.ndarray, window: np.ndarray) -> list[tuple]:
    return list(zip(window.tolist(), n.tolist(), start.tolist(), strict=True))


def _covered(size: int, start: np.ndarray, n: np.ndarray, window: np.ndarray) -> list[tuple]:
    """How many of a text's words the occurrences cover, and the distinct windows; nothing without any."""
    edge = np.bincount(start, minlength=size + 1) - np.bincount(start + n, minlength=size + 1)
    return [(int(np.count_nonzero(np.cumsum(edge)[:size])), np.unique(window).tolist())] if len(start) else []


def proximity_matches(docs: DataFrame, queries: DataFrame, span: int, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, matches) as phrase_matches(), but a query occurs where all its terms, in any order and as often as it has
    them, stand within `span` consecutive words; matches has (seq, window, start, end), the tightest such stretch around
    each occurrence of the query's rarest term."""
    anchors, rows, posts = _index(docs, id_col, text, queries)
    p1 = posts.select(F.col("term").alias("t1"), "seq", F.col("place").alias("a"))
    found = anchors.select("window", "t1").join(p1, "t1").join(queries.select("window", "terms").dropDuplicates(["window"]), "window")
    found, _ = common.write_table(found.groupBy("seq").agg(F.collect_set(F.struct("window", "a", "terms")).alias("c")), "found")
    words = _words_of(docs, id_col, text, _holders(rows, found))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for seq, words, cs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                h = words.values.to_numpy()
                for c in cs:
                    terms, k = np.unique(c["terms"], return_counts=True)
                    lo = max(0, c["a"] - span + 1)
                    near = h[lo : c["a"] + span]
                    best = None
                    for i in range(len(near)):
                        need = dict(zip(terms.tolist(), k.tolist(), strict=True))
                        left = sum(need.values())
                        for j in range(i, min(i + span, len(near))):
                            if need.get(int(near[j]), 0) > 0:
                                need[int(near[j])] -= 1
                                left -= 1
                            if not left:
                                if lo + i <= c["a"] <= lo + j and (best is None or j - i < best[1] - best[0]):
                                    best = (i, j)
                                break
                    if best:
                        out.append((seq, c["window"], lo + best[0], lo + best[1] + 1))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["seq", "window", "start", "end"])

    return rows.select("id", "seq", "n_words"), words.join(found, "seq").select("seq", "words", "c").mapInArrow(compare, "seq long, window long, start long, end long").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """For every row of docs: id, n_words, n_hit (words inside any occurrence of any window), items (the ids of items with
    occurring windows, as strings in string order).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, compared by 64-bit hashes; null has
    none. Rows with equal word sequences share the search; each keeps its own row. No items: nothing is hit.
    """
    windows, _ = common.write_table(item_windows(items, item_id, item_text, n), "windows")
    anchors, rows, posts = _index(docs, id_col, text, windows)
    found, at_found = common.write_table(_places(anchors, posts), "found")
    words = _words_of(docs, id_col, text, _holders(rows, found))
    hit = words.join(found, "seq").select("seq", "words", "c").mapInArrow(_compare(_covered, "seq", "n_hit", "windows"), "seq long, n_hit long, windows array<long>")
    hit, at_hit = common.write_table(hit, "hit")
    common.drop_table(docs.sparkSession, at_found)
    # A window that very many texts have is split, so that its items don't all meet them in one task.
    holds, at_holds = common.write_table(hit.select("seq", F.explode("windows").alias("window")), "matches")
    of = common.split_join(holds, windows.select("window", "item").distinct(), ["window"]).groupBy("seq").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per, _ = common.write_table(hit.select("seq", "n_hit").join(of, "seq"), "contamination")
    common.drop_table(docs.sparkSession, at_hit)
    common.drop_table(docs.sparkSession, at_holds)
    out = rows.join(per, "seq", "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of an item. Rows without an id are judged by a key made from the text.

    Rows with equal ids go together. Null and empty texts stay, as does everything if there are no items. Columns pass
    through, whatever their names."""
    key = common.free_names(docs.columns, "key")[0]
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text))))
    with common.dropping() as kept:
        bad, at = common.write_table(contamination(keyed, items, key, text, n=n).where("n_hit > 0").select(F.col("id").alias(key)).distinct(), "bad")
        kept.append(at)
    return common.without_ids(keyed, bad, key).select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: its words, those inside windows of benchmark items, and these items.

    A null or empty text has no words; equal texts give equal rows; a null item_id is the empty string."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, items).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
