"""Shared plumbing: tables in the cluster's shared folder, fixed-size membership bitmaps."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP_LOG2 = 26

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables of write_table() that were not dropped yet, by path.
_written: dict[str, SparkSession] = {}

#: Paths that the innermost dropping() of this thread has seen written.
_scope: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset and driver and executors are one process (master local[...]), as in tests, a folder of its own is
    set; on a cluster it's an error.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{key} is not set: it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowtally-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def write_table(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write df to the shared folder and return it reread, with its path: lineage is cut, lost executors cost nothing.

    The table stays until drop_table(), dropping(), drop_written() or the end of the driver, as results are read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowtally/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    if (mine := _scope.get()) is not None:
        mine.append(path)
    # What the write shuffled is deleted with its end: the plan is not run again, its result is reread.
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path), path


def give_back(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage once its heap has grown beyond half of what it may take; it shrinks by that. Otherwise
    what the plans of many short jobs leave behind stays until the heap is full."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // 2:
        jvm.java.lang.System.gc()


def fetched(df: DataFrame, schema: pa.Schema, rows: int = 500) -> pa.Table:
    """df's rows on the driver as a table of the given schema. One partition comes at a time, so that the JVM never holds them all;
    df should be a written table, as each partition is a job."""
    batches, held = [], []
    for r in df.select(*schema.names).toLocalIterator():
        held.append(r)
        if len(held) == rows:
            batches.append(_columns(held, schema))
            held = []
    return pa.Table.from_batches([*batches, _columns(held, schema)], schema)


def _columns(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of write_table() once everything that reads it has been written."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.pop(path, None)


@contextmanager
def dropping(*keep: str) -> Iterator[list[str]]:
    """On leaving, also by an error, delete the tables that this thread has written inside, but those whose paths are in the
    list that it gives; these count as written where dropping() was entered."""
    mine, kept = [], list(keep)
    before = _scope.set(mine)
    try:
        yield kept
    finally:
        _scope.reset(before)
        outer = _scope.get()
        for path in mine:
            if path not in kept and path in _written:
                drop_table(_written[path], path)
            elif path in kept and outer is not None:
                outer.append(path)


def drop_written() -> None:
    """Delete every table that sessions which still run have written so far: for when all results are elsewhere."""
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            drop_table(spark, path)


atexit.register(drop_written)


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until none of the columns has it (names differ by more than case)."""
    held, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in held:
            n = "_" + n
        held.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let_sql(value: str, name: str, body: str) -> str:
    """let() as SQL: body, with name standing for the value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running_sql(values: str, step: str = "s + x") -> str:
    """SQL for an array: for each element of an array of ints, the sum (or another fold of s and x, from 0) of those before it.

    Done in parts of about the root of the array's length, so that no element is folded more often than a part is long.
    (As text, one call makes the expression; with functions of columns it takes hundreds.)
    """
    fold = lambda a: f"aggregate({a}, 0, (s, x) -> {step})"
    size = "CAST(ceil(sqrt(size(ra))) AS INT)"
    parts = f"transform(sequence(0, CAST(floor((size(ra) - 1) / {size}) AS INT)), rk -> slice(ra, rk * {size} + 1, {size}))"
    both = let_sql("rb", "s", let_sql(fold("slice(rq, 1, ri)"), "x", step))
    one = let_sql(fold("slice(rt, 1, rj)"), "rb", f"transform(rq, (rx, ri) -> {both})")
    every = let_sql(f"transform(rp, rq -> {fold('rq')})", "rt", f"flatten(transform(rp, (rq, rj) -> {one}))")
    return let_sql(values, "ra", f"CASE WHEN size(ra) > 0 THEN {let_sql(parts, 'rp', every)} ELSE CAST(array() AS ARRAY<INT>) END")


def text_sql(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Rows of a table that are sent to every executor at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000


#: A key with so many rows or fewer isn't worth splitting.
FEW_ROWS = 200


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts) of the keys with more than one shuffle partition's share of df's rows (and than FEW_ROWS), and how many
    shares they have.

    There are fewer of them than shuffle partitions, whatever df holds, so the table may be broadcast; it is written.
    """
    shards = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    per = df.groupBy(*keys).agg(F.count("*").alias("k"))
    share = max(FEW_ROWS, df.count() // shards)
    return write_table(per.where(F.col("k") > share).select(*keys, F.ceil(F.col("k") / share).cast("int").alias("parts")), "hot")[0]


def dealt(df: DataFrame, hot: DataFrame, keys: list[str], part: str, by: list[str]) -> DataFrame:
    """df with a column `part`: rows of a hot key are dealt over its parts by a hash of the columns `by`, so that a task that
    runs again deals alike; all others are in part 0."""
    n = free_names([*df.columns, part], "parts")[0]
    return df.join(F.broadcast(hot.withColumnRenamed("parts", n)), keys, "left").withColumn(part, F.pmod(F.xxhash64(*by), F.coalesce(F.col(n), F.lit(1))).cast("int")).drop(n)


def repeated(df: DataFrame, hot: DataFrame, keys: list[str], part: str) -> DataFrame:
    """df with a column `part`, a row once for each part of its key: the other side of a join of dealt() rows."""
    n = free_names([*df.columns, part], "parts")[0]
    return df.join(F.broadcast(hot.withColumnRenamed("parts", n)), keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))).drop(n)


def split_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """big joined to small, which has each key at most a few times, with hot keys of big split.

    A small table of up to BROADCAST_ROWS rows is broadcast. Otherwise rows of big's hot_keys() are dealt over parts (by a
    hash of the columns `by`, else all) and small's rows of these keys repeated for each. big is read twice more: it
    should be a written table. how: inner, left, left_semi or left_anti.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    part = free_names([*big.columns, *small.columns], "part")[0]
    hot = hot_keys(big, keys)
    return dealt(big, hot, keys, part, by or big.columns).join(repeated(small, hot, keys, part), [*keys, part], how).drop(part)


#: Ids that a filter sends to every executor at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is in ids (distinct, of one column of that name); rows without a key stay."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti")


def bitmap(df: DataFrame, key: str, log2_bits: int = BITMAP_LOG2) -> np.ndarray:
    """A one-hash membership bitmap over a long column, 2**log2_bits bits at every input size.

    The driver receives at most 2**(log2_bits - 6) words (8 MB for 26), whatever df holds. A value that was in df
    always tests true; others do so in proportion to how full the bitmap is, so callers must check again by a join.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - log2_bits)
    rows = (
        df.where(F.col(key).isNotNull())
        .select(h.alias("h"))
        .groupBy(F.shiftright("h", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    )
    got = rows.toArrow()
    words = np.zeros(1 << (log2_bits - 6), np.uint64)
    words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return words


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64_long(v: np.ndarray) -> np.ndarray:
    """xxHash64 of 8-byte integers with seed 42, as Spark's xxhash64() gives it for one long column."""
    rot = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = np.uint64(42) + _P5 + np.uint64(8)
        h = h ^ (rot(v.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
        h = rot(h, 27) * _P1 + _P4
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the longs may be in the bitmap."""
    bits = int(len(words) * 64).bit_length() - 1
    h = xxhash64_long(values) >> np.uint64(64 - bits)
    return (words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is written inside goes to Python and back in batches of so many rows at most. Spark's own of 10,000 whole texts are
    held several times outside the heap, by the executor as by its workers, where they count against its memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows, so that what is made of one stays small; freed memory goes back to the system."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        pa.default_memory_pool().release_unused()


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list<int64> array with counts[i] values in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
