"""Token counts by a separator scan over flat token files that have no index."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: End-of-document identifier of the 50k byte-level vocabulary; encode_ordinary never yields it.
END = 50256
#: Bytes in a block of a flat file.
BLOCK = 1 << 20
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How this public vocabulary cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

FLAT = "file string, block long, payload binary"
INDEX = "file string, place long, doc_id long"


@lru_cache(maxsize=1)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", block: int = BLOCK) -> DataFrame:
    """Documents as flat token files: little-endian uint16 identifiers, END after each document, cut into blocks.

    One file per partition of docs, as rows (file, block, payload, ids): documents cross block borders freely. ids
    holds the doc_id of the documents that end in the block, in order; it is kept apart from the flat file and only
    tells afterwards whose counts they are. A null text is an empty document. Every text is tokenised whole. The driver
    sends the vocabulary's file to the executors, which need not see its path.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    own = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        enc, name = encoder(SparkFiles.get(own)), uuid.uuid4().hex
        held, ids, size, no = [], [], 0, 0

        def out(last: bool):
            nonlocal held, ids, size, no
            flat = np.concatenate([np.zeros(0, np.uint16), *held])
            per = block // 2
            cuts = range(0, len(flat) if last else len(flat) // per * per, per)
            at = 0
            for c in cuts:
                piece = flat[c : c + per]
                k = int(np.count_nonzero(piece == END))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([no], pa.int64()), pa.array([piece.tobytes()], pa.binary()), pa.array([ids[at : at + k]], pa.list_(pa.int64()))], names=["file", "block", "payload", "ids"])
                no, at = no + 1, at + k
            held = [flat[len(cuts) * per :]] if not last else []
            ids, size = ids[at:], 2 * sum(map(len, held))

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.array(enc.encode_ordinary(t.as_py() or ""), np.uint16)
                held += [got, np.array([END], np.uint16)]
                ids.append(i)
                size += 2 * len(got) + 2
                if size >= 2 * block:
                    yield from out(False)
        if held:
            yield from out(True)

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, "file string, block long, payload binary, ids array<long>")


def flat_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Flat token files under path as rows (file, block, payload). Block must be even; a file is read by one task and has under 2 GB."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_buffer()
                for k in range(0, max(len(data), 1), block):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k // block], pa.int64()), pa.array([data[k : k + block].to_pybytes()], pa.binary())], names=["file", "block", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, FLAT)


def scan(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """(file, place, n_tokens) for each document of flat files given as (file, block, payload).

    Each block is searched at once: its separators' offsets give the lengths between them, what stands before the first
    and after the last. A prefix scan over the blocks' sums (one small row per block, by file) numbers the documents
    and adds what earlier blocks left open. Tokens after a file's last separator form a last document; an empty file
    has none. Other columns are ignored.
    """
    width = np.dtype(dtype).itemsize

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, first, last, inner = [], [], [], []
            for p in b.column(2):
                ids = np.frombuffer(p.as_buffer(), dtype) if p.is_valid else np.zeros(0, dtype)
                at = np.flatnonzero(ids == end)
                n.append(len(ids))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1 if len(at) else np.zeros(0, np.int64))
            counts = np.array([len(x) for x in inner], np.int64)
            lists = common.long_lists(np.concatenate([np.zeros(0, np.int64), *inner]).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), lists], names=["file", "block", "n", "first", "last", "inner"])

    assert width in (2, 4)
    found = blocks.select("file", "block", "payload").mapInArrow(search, "file string, block long, n long, first long, last long, inner array<long>")
    by = Window.partitionBy("file").orderBy("block")
    past, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    seps = F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)
    t = (
        found.withColumn("at", F.coalesce(F.sum("n").over(past), F.lit(0)))
        .withColumn("before", F.coalesce(F.sum(seps).over(past), F.lit(0)))
        .withColumn("open", F.coalesce(F.last(F.col("at") + F.col("last"), ignorenulls=True).over(past), F.lit(-1)))
        .withColumn("close", F.coalesce(F.last(F.col("at") + F.col("last"), ignorenulls=True).over(upto), F.lit(-1)))
        .withColumn("final", F.lead("block").over(by).isNull())
    )
    head = F.when(F.col("first").isNotNull(), F.concat(F.array(F.col("at") + F.col("first") - F.col("open") - 1), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    rest = F.col("at") + F.col("n") - F.col("close") - 1
    tail = F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>"))
    return t.select("file", "before", F.posexplode(F.concat(head, tail)).alias("k", "n_tokens")).select("file", (F.col("before") + F.col("k")).alias("place"), "n_tokens")


def document_tokens(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_tokens) of every row: packed into flat files in the shared folder, then counted by scan().

    A null or empty text has 0 tokens. Rows that repeat an id, and rows without one, have a row each. Very long texts run
    over as many blocks as they fill. No rows give none; other columns are ignored.
    """
    packed, _ = common.write_table(pack(docs, **how), "tokens", "zstd")
    counts = scan(packed)
    by = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whose = (
        packed.select("file", "block", "ids")
        .withColumn("before", F.coalesce(F.sum(F.size("ids")).over(by), F.lit(0)))
        .select("file", "before", F.posexplode("ids").alias("k", "doc_id"))
        .select("file", (F.col("before") + F.col("k")).alias("place"), "doc_id")
    )
    return whose.join(counts, ["file", "place"], "left").select("doc_id", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: the tokens of its whole text (null: none)."""
    return document_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
