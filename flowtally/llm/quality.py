"""Quality classifier: heuristic labellers weighed by expectation-maximisation, a hashed linear scorer on their labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum

#: Different texts that the linear scorer is fitted on, about, at every input size: those that hash lowest.
FIT_ROWS = 20_000
WEIGHT_BITS = 18
#: Weight of the starting tables in expectation-maximisation, as a share of all documents, for
#: bad and for good documents.
PRIOR_SHARE = (0.02, 2.0)
#: How often a labeller votes bad on a bad and on a good document, at the start.
BAD_VOTES = (0.25, 0.002)
#: Share of good documents, at the start.
PRIOR = 0.8
#: A document is rejected below this score (probability of good quality).
KEEP = 0.5

# Common words of English, French, German and Spanish prose.
COMMON = (
    "the of and to in is it that for was on with as are be this by not or at from an a "
    "de la le les et des un une du en est que qui pour dans ce pas sur par au ou avec son il elle "
    "der die das und ist von zu mit den nicht ein eine auf dem des im als sich auch für "
    "el los las y se del al no lo una por con su para es como"
).split()

#: The labellers, in the order of their bits: each votes good (2), bad (1) or nothing (0).
LABELLERS = ("symbols", "capitals", "repeats", "bars", "common_words", "word_length", "endings", "digits")


@dataclass(frozen=True)
class Features:
    """What the labellers look at, one value per document."""

    words: np.ndarray
    symbols: np.ndarray
    capitals: np.ndarray
    repeats: np.ndarray
    bars: np.ndarray
    common_words: np.ndarray
    word_length: np.ndarray
    endings: np.ndarray
    digits: np.ndarray


_is = lambda s: np.isin(np.arange(256), np.frombuffer(s.encode(), np.uint8))
_SYMBOL, _UPPER, _LOWER, _DIGIT, _BAR, _END = _is("#$%&*=<>{}[]\\^~_@|!"), _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("abcdefghijklmnopqrstuvwxyz"), _is("0123456789"), _is("|"), _is(".")


def features(texts: pa.Array) -> Iterator[tuple[int, int, Features, np.ndarray, np.ndarray]]:
    """(first row, end row, features, words per row, alphanumeric word hashes) over runs of whole texts."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.string())
    known = np.sort(textnum.word_hash(COMMON, textnum.ALNUM))
    for lo, hi, counts, h in textnum.ALNUM.blocks(texts):
        part = texts.slice(lo, hi - lo)
        offs = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        raw = part.buffers()[2]
        data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offs[0] : offs[-1]]
        n = np.maximum(np.diff(offs), 1)

        def per_row(mask: np.ndarray, at: np.ndarray = offs - offs[0]) -> np.ndarray:
            total = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=total[1:])
            return np.diff(total[at])

        words = np.maximum(counts, 1)
        at = np.concatenate([[0], np.cumsum(counts)])
        seen = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        different = np.array([len(np.unique(h[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
        letters = per_row(_UPPER[data] | _LOWER[data])
        f = Features(
            counts,
            per_row(_SYMBOL[data]) / n,
            per_row(_UPPER[data]) / np.maximum(letters, 1),
            1 - different / words,
            per_row(_BAR[data]) / words,
            per_row(seen, at) / words,
            per_row(textnum.ALNUM.part[data]) / words,
            per_row(_END[data]) / words,
            per_row(_DIGIT[data]) / n,
        )
        yield lo, hi, f, counts, h


def votes(f: Features) -> np.ndarray:
    """Each document's votes as one number in base 3; a document without words gets bad votes from all that can tell."""
    long = f.words >= 20

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 1, np.where(good, 2, 0))

    empty = f.words == 0
    never = np.zeros(len(f.words), bool)
    each = (
        vote(empty | (f.symbols > 0.06), never),
        vote(long & (f.capitals > 0.4), never),
        vote(long & (f.repeats > 0.8), never),
        vote(f.bars > 0.2, never),
        vote(empty | (long & (f.common_words < 0.04)), long & (f.common_words > 0.15)),
        vote(empty | (f.word_length > 20), never),
        vote(long & (f.endings < 0.004), long & (f.endings > 0.02) & (f.endings < 0.6)),
        vote(long & (f.digits > 0.2), never),
    )
    return sum(v * 3**k for k, v in enumerate(each)).astype(np.int64)


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents. tables[k, c, v]: probability that labeller k votes v on class c (0 bad, 1 good)."""

    prior: float
    tables: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        log = np.log([[1 - self.prior], [self.prior]]) + np.zeros((2, len(codes)))
        for k in range(len(self.tables)):
            log += np.log(self.tables[k][:, codes // 3**k % 3])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def start_tables(codes: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    """The tables that expectation-maximisation starts from: BAD_VOTES, and other votes as often as all documents have them."""
    tables = np.empty((labellers, 2, 3))
    for k in range(labellers):
        seen = np.bincount(codes // 3**k % 3, counts, 3) + np.array([1e-3, 0, 1e-3]) * (counts.sum() + 1)
        for c, bad in enumerate(BAD_VOTES):
            tables[k, c] = seen * (1 - bad) / (seen[0] + seen[2])
            tables[k, c, 1] = bad
    return tables


def fit_labels(codes: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 200, share: tuple[float, float] = PRIOR_SHARE) -> LabelModel:
    """Expectation-maximisation over the counts of all vote patterns (at most 3**labellers rows, from all documents).

    Each labeller looks for one fault, so it misses most bad documents but seldom calls a good one bad. That is the
    start, and it stays in as pseudo-counts (share): without it a fault that is alone in its documents would be
    explained away by the silence of the other labellers.
    No documents: the start is returned.
    """
    total = counts.sum()
    tables = start_tables(codes, counts, labellers)
    model = LabelModel(PRIOR, tables)
    for _ in range(rounds if total else 0):
        good = model.posterior(codes) * counts
        bad = counts - good
        new = np.empty_like(tables)
        for k in range(labellers):
            v = codes // 3**k % 3
            for c, w in enumerate((bad, good)):
                new[k, c] = np.bincount(v, w, 3) + share[c] * total * tables[k, c]
        new /= new.sum(axis=2, keepdims=True)
        prior = float(np.clip(good.sum() / total, 0.05, 0.95))
        done = abs(prior - model.prior) < 1e-7 and np.abs(new - model.tables).max() < 1e-6
        model = LabelModel(prior, new)
        if done:
            break
    return model


def hashed(f: Features, counts: np.ndarray, h: np.ndarray, bits: int = WEIGHT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the linear scorer: (indices, values, entries per row). Words and binned measures share one hashed space."""
    size = np.uint64((1 << bits) - 1)
    binned = np.stack([np.minimum(x * s, 15).astype(np.uint64) + np.uint64(16 * k) for k, (x, s) in enumerate(((f.symbols, 100), (f.capitals, 20), (f.repeats, 16), (f.bars, 20), (f.common_words, 30), (f.word_length, 1), (f.endings, 50), (f.digits, 40)))], 1)
    word = ((h >> np.uint64(40)) & size).astype(np.int64)
    rows = len(counts)
    per = counts + binned.shape[1]
    at = np.concatenate([[0], np.cumsum(per)])
    index, value = np.empty(at[-1], np.int64), np.empty(at[-1], np.float32)
    k = binned.shape[1]
    spot = at[:-1, None] + np.arange(k)
    index[spot] = (textnum.mix(binned) & size).astype(np.int64)
    value[spot] = 1.0
    rest = np.ones(at[-1], bool)
    rest[spot] = False
    index[rest] = word
    value[rest] = np.repeat(4 / np.maximum(counts, 1), counts)
    return index, value, per if rows else counts


def summed(index: np.ndarray, value: np.ndarray, per: np.ndarray, bits: int = WEIGHT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same features with one entry per row and index, values added up."""
    both, back = np.unique(np.repeat(np.arange(len(per)), per) << bits | index, return_inverse=True)
    return both & ((1 << bits) - 1), np.bincount(back, value, len(both)).astype(np.float32), np.bincount(both >> bits, minlength=len(per))


def linear(index: np.ndarray, value: np.ndarray, per: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    total = np.zeros(len(index) + 1)
    np.cumsum(w[index] * value, out=total[1:])
    at = np.concatenate([[0], np.cumsum(per)])
    return 1 / (1 + np.exp(-np.clip(total[at[1:]] - total[at[:-1]] + bias, -30, 30)))


def fit_linear(index: np.ndarray, value: np.ndarray, per: np.ndarray, target: np.ndarray, times: np.ndarray | None = None, bits: int = WEIGHT_BITS, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by adaptive gradient steps over batches of rows in the given order; a row
    weighs as much as its times, but at most a tenth of its batch."""
    w, bias, g2, gb = np.zeros(1 << bits), 0.0, np.full(1 << bits, 1e-6), 1e-6
    at = np.concatenate([[0], np.cumsum(per)])
    weight = np.ones(len(per)) if times is None else np.minimum(times, 51.2)
    for _ in range(epochs):
        for a in range(0, len(per), 512):
            b = min(a + 512, len(per))
            i, v, n = index[at[a] : at[b]], value[at[a] : at[b]], per[a:b]
            err = (linear(i, v, n, w, bias) - target[a:b]) * weight[a:b]
            which, back = np.unique(i, return_inverse=True)
            g = np.bincount(back, np.repeat(err, n) * v, len(which)) / (b - a) + 1e-6 * w[which]
            g2[which] += g * g
            w[which] -= 0.2 * g / np.sqrt(g2[which])
            s = err.mean()
            gb += s * s
            bias -= 0.2 * s / np.sqrt(gb)
    return w, bias


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit both models: votes are counted over all documents; the scorer sees at most about fit_rows of them.

    The sample is the texts with the lowest hashes, the share being set from the number of different texts; a text that
    repeats counts as often as it does, in one row. So neither ids nor copies decide how many rows reach the driver. They
    do so as the summed features of the whole text, one entry per place of the hashed space at most, however long a text.
    A null text is an empty one. No rows: a model that scores 0.5 everywhere.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            for _, _, f, _, _ in features(b.column(0)):
                got += np.bincount(votes(f), minlength=len(got))
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(got[at], pa.int64())], names=["code", "n"])

    found = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    codes, counts = found["code"].to_numpy(), found["n"].to_numpy()
    labels = fit_labels(codes, counts)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h = F.xxhash64(F.lit("quality"), whole).bitwiseAND(F.lit(2**62 - 1))
    texts = docs.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    share = 1.0 if texts <= fit_rows else fit_rows / texts
    bound = int(share * 2**62) - 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, f, n, h in features(b.column(1)):
                index, value, per = summed(*hashed(f, n, h))
                at = np.concatenate([[0], np.cumsum(per)])
                code = votes(f)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(n)), b.column(2).slice(lo, len(n)), pa.array(code), pa.array([index[x:y].astype(np.int32).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([value[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    names=["h", "k", "code", "i", "v"],
                )

    sample = docs.select(h.alias("h"), whole.alias("t")).where(F.col("h") <= bound).groupBy("h").agg(F.first("t").alias("t"), F.count("*").alias("k"))
    found, at = common.write_table(sample.select("h", "t", "k").mapInArrow(gather, "h long, k long, code long, i binary, v binary"), "fit")
    rows = common.fetched(found, pa.schema([("h", pa.int64()), ("k", pa.int64()), ("code", pa.int64()), ("i", pa.binary()), ("v", pa.binary())]))
    common.drop_table(docs.sparkSession, at)
    if not rows.num_rows:
        return QualityModel(labels, np.zeros(1 << WEIGHT_BITS), 0.0)
    index, value, per, code, times = _in_order(rows)
    del rows
    pa.default_memory_pool().release_unused()
    w, bias = fit_linear(index, value, per, labels.posterior(code), times)
    return QualityModel(labels, w, bias)


def _in_order(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices, values, entries per row, votes and times of gathered rows by their hashes; entries are copied once, to 8 bytes each."""
    order = pc.sort_indices(rows, [("h", "ascending"), ("code", "ascending"), ("i", "ascending")]).to_numpy()
    per = np.concatenate([pc.binary_length(c).to_numpy(zero_copy_only=False) for c in rows["i"].chunks])[order].astype(np.int64) // 4
    end = np.cumsum(per)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = np.empty(end[-1], np.int32), np.empty(end[-1], np.float32)
    for to, column in zip(out, ("i", "v"), strict=True):
        for k, x in zip(place, rows[column], strict=True):
            to[end[k] - per[k] : end[k]] = np.frombuffer(x.as_buffer(), to.dtype)
    return *out, per, rows["code"].to_numpy()[order], rows["k"].to_numpy()[order]


SCORED = (("quality_votes", "long"), ("quality_posterior", "double"), ("quality_score", "double"), ("quality_keep", "boolean"))


def scored(docs: DataFrame, model: QualityModel, text: str = "text", keep: float = KEEP) -> DataFrame:
    """docs with the labellers' votes (base 3), the label model's posterior, the scorer's probability and the decision.

    Columns of docs with those names are replaced; all others pass through. A null or empty text is scored like any
    other (no words: bad votes). No document is left out.
    """
    names = [n for n, _ in SCORED]
    docs = docs.select(*[c for c in docs.columns if c not in names])
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast((model.labels.prior, model.labels.tables, model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, tables, w, bias = held.value
        labels = LabelModel(prior, tables)
        for b in batches:
            code, p = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, f, n, h in features(b.column(at)):
                code.append(votes(f))
                p.append(linear(*hashed(f, n, h), w, bias))
            code, p = np.concatenate(code), np.concatenate(p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array(labels.posterior(code)), pa.array(p), pa.array(p >= keep)], names=[*b.schema.names, *names])

    from pyspark.sql import types as T

    kinds = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, kinds[k]) for n, k in SCORED]]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: the labellers' votes, the label model's posterior, the scorer's score and decision.

    A null or empty text gets bad votes and is rejected where the corpus has texts to learn from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, fit(docs)).drop("text")
