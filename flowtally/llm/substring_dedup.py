"""Substring deduplication: an FM-index per shard, searched backward over wavelet matrices for streamed documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum

#: Words of a window, and of the stretch in it by which windows are dealt to shards.
WINDOW, ANCHOR = 13, 5
#: Words that an FM-index takes at once, but that a shard's group of equal anchors is kept whole.
INDEX_WORDS = 1 << 20


class WaveletMatrix:
    """Rank queries over a sequence of small integers, as packed bits with a running count per 64 of them."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for k in range(bits - 1, -1, -1):
            bit = (seq >> k) & 1 == 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            zeros = len(bit) - int(ones[-1])
            self.levels.append((words, ones, zeros))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.bits = bits

    def rank(self, value: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often value[i] stands before at[i]; start[i] is where the value's run begins on the last level."""
        for k, (words, ones, zeros) in enumerate(self.levels):
            one = (value >> (self.bits - 1 - k)) & 1 == 1
            w = at >> 6
            r = ones[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(one, zeros + r, at - r)
        return at - start


class FMIndex:
    """Full-text index of segments of words: Burrows-Wheeler transform, wavelet matrix, symbol counts, suffix array."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int) -> None:
        self.alphabet, codes = np.unique(words, return_inverse=True)
        self.segment_starts = np.cumsum(lengths + 1) - lengths - 1
        n = len(words) + len(lengths)
        text = np.zeros(n, np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = codes + 1
        rank, k = text.copy(), 1
        while k < depth:  # prefix doubling; suffixes need an order by their first `depth` words alone
            nxt = np.zeros(n, np.int64)
            nxt[:-k] = rank[k:]
            nxt[rank == 0] = 0
            key = rank * (int(rank.max()) + 1) + nxt
            key[text == 0] = 0
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank, k = new, 2 * k
        self.order = (np.argsort(rank, kind="stable") if depth > 1 else np.argsort(text, kind="stable")).astype(np.int32)
        bwt = text[self.order - 1]
        sigma = len(self.alphabet) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        bits = max(1, int(sigma - 1).bit_length())
        self.wavelet = WaveletMatrix(bwt, bits)
        # Where each symbol's run begins after the last level: symbols lie there in the order of their reversed bits.
        flip = np.zeros(sigma, np.int64)
        for b in range(bits):
            flip |= ((np.arange(sigma) >> b) & 1) << (bits - 1 - b)
        by = np.argsort(flip, kind="stable")
        sizes = np.bincount(bwt, minlength=sigma)[by]
        self.run = np.empty(sigma, np.int64)
        self.run[by] = np.cumsum(sizes) - sizes
        self.text = text.astype(np.int32)

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step backward for many patterns at once: from the suffixes of P to those of cP."""
        s, base = self.run[c], self.less[c]
        return base + self.wavelet.rank(c, lo, s), base + self.wavelet.rank(c, hi, s)

    def statistics(self, ends: np.ndarray, most: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics by backward search: for each place in text, how many words up to and with it (of `most` at
        most) also stand elsewhere; and the interval of suffixes that begin with the last `threshold` of them, from -1 to -1
        where the match is shorter. Lengths are right up to the depth of the index."""
        c = self.text[ends]
        lo, hi = self.less[c], self.less[c + 1]
        length, first, last = np.zeros(len(ends), np.int64), np.full(len(ends), -1), np.full(len(ends), -1)
        live, k = np.flatnonzero((hi - lo > 1) & (most > 0)), 1
        while len(live):
            length[live] = k
            if k == threshold:
                first[live], last[live] = lo[live], hi[live]
            live = live[most[live] > k]
            a, b = self.extend(lo[live], hi[live], self.text[ends[live] - k])
            lo[live], hi[live] = a, b
            live, k = live[b - a > 1], k + 1
        return length, first, last


def _segments(h: np.ndarray, counts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, row, first word in the block, windows) of the runs of windows that share their smallest anchor."""
    ends = np.repeat(np.cumsum(counts), counts)
    row = np.repeat(np.arange(len(counts)), counts)
    k = len(h) - window + 1
    if k <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    g = textnum.grams(h, anchor)
    best, where = g[:k].copy(), np.arange(k)
    for j in range(1, window - anchor + 1):
        c = g[j : j + k]
        less = c < best
        best[less] = c[less]
        where[less] = np.flatnonzero(less) + j
    start = np.flatnonzero(np.arange(k) + window <= ends[:k])
    if not len(start):
        return _segments(h[:0], counts[:0], window, anchor)
    new = np.ones(len(start), bool)
    new[1:] = (where[start[1:]] != where[start[:-1]]) | (start[1:] != start[:-1] + 1) | (row[start[1:]] != row[start[:-1]])
    at = np.flatnonzero(new)
    first = start[at]
    return best[first], row[first], first, np.diff(np.append(at, len(start)))


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))


def repeated_anchors(docs: DataFrame, id_col: str, text: str, window: int, anchor: int) -> np.ndarray:
    """A bitmap of the anchors that windows of two or more ids have; a few others may pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, counts, h in textnum.PLAIN.blocks(b.column(1)):
                g, row, _, _ = _segments(h, counts, window, anchor)
                order = np.lexsort((row, g))
                g, row = g[order], row[order]
                keep = np.ones(len(g), bool)
                keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(g[keep].view(np.int64)), b.column(0).take(pa.array(lo + row[keep]))], names=["g", "id"])

    df = _texts(docs, id_col, text).where("id IS NOT NULL").mapInArrow(run, "g long, id long")
    return common.bitmap(df.groupBy("g").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z"), "g")


def segments(docs: DataFrame, id_col: str, text: str, window: int, anchor: int, known: np.ndarray) -> tuple[DataFrame, str]:
    """(g, key, id, seq, first, words) for the runs of windows whose anchor is in the bitmap.

    key is a hash of the run's words, seq one of the document's; words are 4-byte codes, given once for each key and block
    of documents, with the smallest id of that key in it. Written to the shared folder. Windows are compared within equal
    8-byte anchors, so windows that differ in a word are taken for equal only if they have the same anchor and equal
    codes for all their different words: once in 2**32 such near misses at most.
    """
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, counts, h in textnum.PLAIN.blocks(b.column(1)):
                g, row, first, r = _segments(h, counts, window, anchor)
                keep = common.in_bitmap(held.value, g.view(np.int64))
                g, row, first, r = g[keep], row[keep], first[keep], r[keep]
                if not len(g):
                    continue
                n = r + window - 1
                words = h[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                key = textnum.sequence_hash(words, n)
                begin = (np.cumsum(counts) - counts)[row]
                seq = textnum.sequence_hash(h, counts)[row]
                ids = b.column(0).take(pa.array(lo + row))
                order = np.lexsort((ids.to_numpy(), key))
                lead = np.zeros(len(key), bool)
                lead[order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]] = True
                offs = np.concatenate([[0], np.cumsum(n)]).tolist()
                raw = (words >> np.uint64(32)).astype(np.uint32).tobytes()
                payload = [raw[4 * a : 4 * z] if w else None for a, z, w in zip(offs[:-1], offs[1:], lead.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(key.view(np.int64)), ids, pa.array(seq.view(np.int64)), pa.array(first - begin), pa.array(payload, pa.binary())], names=["g", "key", "id", "seq", "first", "words"])

    df = _texts(docs, id_col, text).where("id IS NOT NULL").mapInArrow(run, "g long, key long, id long, seq long, first long, words binary")
    return common.write_table(df, "segments")


def first_holders(rows: DataFrame, window: int) -> DataFrame:
    """(key, holders): for each window of a segment, the smallest id of all segments that have the window.

    rows: (g, key, id, words), sorted by g within shards. Each block of whole anchor groups gets an FM-index over its
    distinct segments; then the segments are streamed through it: backward search gives the matching statistics of the
    words that end a window, as far as the window, and of those that reach it the interval of suffixes, whose segments
    have the smallest id. Equal windows have equal anchors, so they meet in one index. Segments whose windows are in no
    other segment get their own id throughout.
    """

    def block(keys: np.ndarray, ids: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
        order = np.lexsort((ids, keys))
        lead = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]
        keys, low = keys[lead], ids[lead]
        text = [np.frombuffer(words[i], np.uint32) for i in lead]
        lengths = np.array([len(x) for x in text], np.int64)
        fm = FMIndex(np.concatenate(text), lengths, window)
        r = lengths - window + 1
        seg = np.repeat(np.arange(len(r)), r)
        ends = np.repeat(fm.segment_starts, r) + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r) + window - 1
        reach, a, z = fm.statistics(ends, np.full(len(ends), window), window)
        best = low[seg].copy()
        shared = np.flatnonzero(reach >= window)
        if len(shared):
            suffix_low = low[np.searchsorted(fm.segment_starts, fm.order, "right") - 1]
            u, back = np.unique(a[shared], return_inverse=True)
            end = np.empty(len(u), np.int64)
            end[back] = z[shared]
            cuts = np.stack([u, np.minimum(end, len(suffix_low) - 1)], 1).ravel()
            mins = np.minimum.reduceat(suffix_low, cuts)[::2]
            last = end == len(suffix_low)
            mins[last] = np.minimum(mins[last], suffix_low[-1])
            best[shared] = np.minimum(best[shared], mins[back])
        return pa.RecordBatch.from_arrays([pa.array(keys), common.long_lists(best, r)], names=["key", "holders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column(3).to_pylist()
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), w))
            size += sum(map(len, w)) // 4
            if size >= INDEX_WORDS and held[0][0][0] != held[-1][0][-1]:
                g, key, ids = (np.concatenate([x[k] for x in held]) for k in range(3))
                every = [y for x in held for y in x[3]]
                at = int(np.searchsorted(g, g[-1]))  # the last group may go on
                yield block(key[:at], ids[:at], every[:at])
                held = [(g[at:], key[at:], ids[at:], every[at:])]
                size = sum(map(len, every[at:])) // 4
        if held:
            g, key, ids = (np.concatenate([x[k] for x in held]) for k in range(3))
            yield block(key, ids, [y for x in held for y in x[3]])

    return rows.select("g", "key", "id", "words").mapInArrow(run, "key long, holders array<long>")


def hot_holders(rows: DataFrame, window: int) -> DataFrame:
    """(key, holders) as first_holders() gives them, for segments of anchors with more than one shard's share of segments.

    An index would have to hold all segments of such an anchor in one task. Equal windows have equal hashes, so their
    segments are taken apart and the windows themselves dealt: the smallest id of each is summed in every task first.
    rows is written, and holds few anchors.
    """

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            text = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column(3)]
            r = np.array([len(x) - window + 1 for x in text], np.int64)
            row = np.repeat(np.arange(len(r)), r)
            place = np.arange(len(row)) - np.repeat(np.cumsum(r) - r, r)
            grams = np.concatenate([textnum.grams(textnum.mix(x.astype(np.uint64)), window) for x in text])
            w = textnum.mix(grams ^ b.column(0).to_numpy().view(np.uint64)[row])
            which = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(1).take(which), pa.array(place), pa.array(w.view(np.int64)), b.column(2).take(which)], names=["key", "place", "w", "id"])

    each, _ = common.write_table(rows.select("g", "key", "id", "words").mapInArrow(take_apart, "key long, place long, w long, id long"), "windows")
    places, _ = common.write_table(each.select("key", "place", "w").distinct(), "windows")
    low, _ = common.write_table(each.groupBy("w").agg(F.min("id").alias("low")), "windows")
    got = common.split_join(places, low, ["w"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "low"))).alias("l"))
    return got.select("key", F.col("l.low").alias("holders"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, seq, spans): for each document with words to remove, [start, end) word intervals, in no order.

    A word is in a span if a window of `window` consecutive words covers it whose words also start in a document with a
    smaller id. Words are runs of non-space bytes, unchanged, compared by hashes (see segments()). Rows without an id neither lose
    nor claim words; rows with equal ids do not claim from each other. seq tells texts of equal ids apart.
    """
    spark = docs.sparkSession
    rows, at_rows = segments(docs, id_col, text, window, anchor, repeated_anchors(docs, id_col, text, window, anchor))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lead = rows.where("words IS NOT NULL").select("g", "key", "id", "words")
    hot = common.hot_keys(lead, ["g"]).select("g")
    dealt = lead.join(F.broadcast(hot), "g", "left_anti").repartition(shards, "g").sortWithinPartitions("g")
    holders = first_holders(dealt, window)
    if not hot.isEmpty():
        many, _ = common.write_table(lead.join(F.broadcast(hot), "g", "left_semi"), "hot")
        holders = holders.unionByName(hot_holders(many, window))
    holders, at_holders = common.write_table(holders, "holders")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, first = b.column(0).to_numpy(), b.column(2).to_numpy()
            lists = b.column(3)
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            hit = flat < ids[row]
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            on = np.flatnonzero(hit)
            if len(on):
                new = np.ones(len(on), bool)
                new[1:] = (on[1:] != on[:-1] + 1) | (row[on[1:]] != row[on[:-1]])
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(on)) - 1
                which = pa.array(row[on[s]])
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), pa.array(place[on[s]]), pa.array(place[on[e]] + window)], names=["id", "seq", "start", "end"])

    # A segment of one key may stand in very many documents: such keys are split. A key's anchor is in one shard and one
    # block, so that each key has one list of holders.
    often = common.hot_keys(rows, ["key"])
    one = common.dealt(rows.select("id", "seq", "first", "key"), often, ["key"], "part", ["id", "seq", "first"])
    got = one.join(common.repeated(holders, often, ["key"], "part"), ["key", "part"]).select("id", "seq", "first", "holders").mapInArrow(spans, "id long, seq long, start long, end long")
    out, _ = common.write_table(got.groupBy("id", "seq").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    common.drop_table(spark, at_rows)
    common.drop_table(spark, at_holders)
    return out


def kept(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept) for every input row: kept is the text of the words that stay, joined by one space, or
    with digest its SHA-256. A null text has no words. Only texts that may lose words are shuffled."""
    found = repeats(docs, id_col, text, window, anchor)
    held = docs.sparkSession.sparkContext.broadcast(common.bitmap(found, "id"))
    final = (lambda words: hashlib.sha256(b" ".join(words)).hexdigest()) if digest else (lambda words: b" ".join(words).decode("utf-8", "replace"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, counts, h in textnum.PLAIN.blocks(b.column(1)):
                part = b.slice(lo, hi - lo)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                may = common.in_bitmap(held.value, ids) & part.column(0).is_valid().to_numpy(zero_copy_only=False)
                texts = part.column(1).cast(pa.binary())
                done = [None if m else final((t.as_py() or b"").split()) for m, t in zip(may.tolist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(textnum.sequence_hash(h, counts).view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(done, pa.string()), pa.array([t.as_py() if m else None for m, t in zip(may.tolist(), texts, strict=True)], pa.binary())], names=["id", "seq", "n_words", "kept", "t"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, done = [], []
            for k, t, s in zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                if k.is_valid:
                    removed.append(0)
                    done.append(k.as_py())
                    continue
                words = (t.as_py() or b"").split()
                stay = np.ones(len(words), bool)
                for x in s or ():
                    stay[x["start"] : x["end"]] = False
                removed.append(int(len(words) - stay.sum()))
                done.append(final([w for w, y in zip(words, stay.tolist(), strict=True) if y]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(done, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    d = _texts(docs, id_col, text).mapInArrow(first, "id long, seq long, n_words long, kept string, t binary")
    whole, part = d.where("kept IS NOT NULL"), d.where("kept IS NULL")
    joined = part.join(found, ["id", "seq"], "left").select("id", "n_words", "kept", "t", "spans").mapInArrow(second, "id long, n_words long, n_removed long, kept string")
    return whole.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept").unionByName(joined)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: its words, those that repeat a 13-word window of a smaller id, a digest of the rest.

    A null or empty text has no words and the digest of nothing. Rows of one id don't claim words from each other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kept(docs, digest=True).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
