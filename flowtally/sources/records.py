"""Multi-line detector logs as records.

Files of any size are read in Spark's own splits: lines are put together to blocks where they lie, and what a split begins
with and ends with (one row each) says which time and which block go on across its borders. Texts of whole files that
already are rows are cut by their headings instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import lineage_cut

_DAY = "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
_STAMP = rf"(?m)^[ \t]*(?={_DAY}[ \t]+\d{{2}}[ \t]+[A-Za-z]+[ \t]+\d{{4}}[ \t]+\d{{2}}:\d{{2}}[ \t\r]*$)"
_SITE = r"(?m)^[ \t]*(?=Int[ \t]+\d+\b)"


def parse(files: DataFrame, sentinels: tuple[int, ...] = (2046, 2047)) -> DataFrame:
    """(source_file, ts_pos, block_pos, ts, site_id, channels) from rows (source_file, value) of whole files.

    State only flows forward from the nearest heading, so a file is cut before each timestamp and each piece before each
    site heading. Text before the first timestamp or heading, blocks without channels and lines "end of file" give no
    record. NA and sentinels are null, 0 stays; of a repeated channel the last value counts.
    """
    text = F.regexp_replace("value", r"(?mi)^[ \t]*end of file.*$", "")
    stamped = files.select("source_file", F.posexplode(F.split(text, _STAMP)).alias("ts_pos", "part"))
    stamp = F.regexp_extract("part", rf"^[ \t]*{_DAY}[ \t]+(\d{{2}}[ \t]+[A-Za-z]+[ \t]+\d{{4}}[ \t]+\d{{2}}:\d{{2}})", 1)
    timed = stamped.withColumn("ts", F.try_to_timestamp(F.regexp_replace(stamp, r"[ \t]+", " "), F.lit("dd MMMM yyyy HH:mm")).cast("timestamp_ntz")).where("ts IS NOT NULL")
    body = F.regexp_replace("part", r"^[^\n]*\n?", "")
    blocks = timed.select("source_file", "ts_pos", "ts", F.posexplode(F.split(body, _SITE)).alias("block_pos", "block")).where("block_pos > 0 OR block RLIKE '^[ \\t]*Int[ \\t]+[0-9]+'")
    return _channels(blocks, sentinels)


def _channels(blocks: DataFrame, sentinels: tuple[int, ...]) -> DataFrame:
    """Records of blocks (source_file, ts_pos, block_pos, ts, block) that begin with a site's heading."""
    pairs = r"(\d+)\s*=\s*((?i)NA|\d+)"
    keys, values = F.regexp_extract_all("block", F.lit(pairs), F.lit(1)), F.regexp_extract_all("block", F.lit(pairs), F.lit(2))
    both = F.zip_with(keys, values, lambda k, v: F.struct(k.cast("int").alias("k"), F.when(~v.try_cast("int").isin(*sentinels), v.try_cast("int")).alias("v")))
    last = F.map_from_entries(F.filter(both, lambda x, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda y: y["k"] == x["k"])))
    out = blocks.select("source_file", "ts_pos", "block_pos", "ts", F.regexp_extract("block", r"^[ \t]*Int[ \t]+(\d+)", 1).try_cast("int").alias("site_id"), last.alias("channels"))
    return out.where("site_id IS NOT NULL AND size(channels) > 0")


_HEADING = (rf"^{_DAY}\s+\d{{2}}\s+[A-Za-z]+\s+\d{{4}}\s+\d{{2}}:\d{{2}}$", r"^Int\s+\d+\b")
_EVENT = "path string, source_file string, start long, pos long, edge boolean, timed boolean, stamp string, block string, opened boolean, began boolean, head string"
_COLUMNS = ("path", "source_file", "start", "pos", "edge", "timed", "stamp", "block", "opened", "began", "head")
#: Splits whose borders are sent to all tasks at most; more are joined by a shuffle of the few blocks before a split's first time.
MOST_SPLITS = 50_000


class _Split:
    """What one split of a file has shown so far: lines before its first heading, the time, and the block that is open."""

    def __init__(self, key: tuple) -> None:
        self.key, self.pos, self.timed, self.stamp, self.began = key, 0, False, None, False
        self.open: list[str] | None = None
        self.head: list[str] = []

    def take(self, lines: list[str], stamps: list[bool], sites: list[bool]) -> Iterator[tuple]:
        """Rows of the blocks that end among these lines."""
        at = 0
        for k in [i for i, (x, y) in enumerate(zip(stamps, sites, strict=True)) if x or y] + [len(lines)]:
            if self.open is not None:
                self.open += lines[at:k]
            elif not self.began:
                self.head += lines[at:k]
            if k == len(lines):
                return
            if self.open is not None:
                yield (*self.key, self.pos, False, self.timed, self.stamp, "\n".join(self.open), None, None, None)
                self.pos += 1
            self.began, at = True, k
            if stamps[k]:
                self.timed, self.stamp, self.open = True, lines[k], None
                at += 1
            else:
                self.open = []

    def border(self) -> tuple:
        """The row of the split's borders; its last block may go on in the next split."""
        block = None if self.open is None else "\n".join(self.open)
        return (*self.key, self.pos, True, self.timed, self.stamp, block, self.open is not None, self.began, "\n".join(self.head))


def _events(lines: DataFrame) -> DataFrame:
    """Blocks of lines (path, source_file, start, line), lines of a split in order: a row for each block that ends in its split, and one
    for each split's borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(_COLUMNS))
        now = None
        for b in batches:
            text, rows = pc.utf8_trim_whitespace(b["line"]), []
            kept = pc.invert(pc.or_(pc.equal(pc.utf8_length(text), 0), pc.match_substring_regex(text, r"(?i)^end of file")))
            stamps, sites = (pc.match_substring_regex(text, x) for x in _HEADING)
            path, start = b["path"], b["start"].to_numpy()
            cuts = [0, *(np.flatnonzero((start[1:] != start[:-1]) | pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
            for a, e in zip(cuts, cuts[1:], strict=False):
                key = (path[a].as_py(), b["source_file"][a].as_py(), int(start[a]))
                if now is None or now.key != key:
                    rows += [now.border()] if now else []
                    now = _Split(key)
                some = kept.slice(a, e - a)
                rows += now.take(*(x.slice(a, e - a).filter(some).to_pylist() for x in (text, stamps, sites)))
            if rows:
                yield batch(rows)
        if now:
            yield batch([now.border()])

    return lines.select("path", "source_file", "start", "line").mapInArrow(run, _EVENT)


def assembled(lines: DataFrame, sentinels: tuple[int, ...] = (2046, 2047), with_path: bool = False) -> DataFrame:
    """Records of lines (path, source_file, start, line), as parse() gives them: start, where a line's split begins in its file, is
    ts_pos, and the block's number in the split block_pos.

    The lines are read twice: first for the borders of the splits, one row each, which are checkpointed; then for the blocks.
    The time at a split's begin is the last one of the splits before it; lines before its first heading go on the block that
    was open there. Nothing but borders is shuffled, sorted or held together, whatever a file's size.
    """
    events = _events(lines)
    borders = lineage_cut(events.where("edge").drop("edge"))
    before = Window.partitionBy("path").orderBy("start")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    b = borders.withColumns({"enter": F.last(F.when(F.col("timed"), F.col("stamp")), True).over(past), "seen": F.coalesce(F.sum(F.col("began").cast("int")).over(past), F.lit(0)), "pending": F.last(F.when(F.col("began"), F.col("opened")), True).over(past)})
    # Lines that a later split begins with go to the block that was open last.
    more = b.where("pending AND head <> ''").groupBy("path", F.col("seen").alias("own")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "head"))).getField("head"), "\n").alias("rest"))
    last = b.where("opened").withColumn("own", F.col("seen") + 1).join(more, ["path", "own"], "left").withColumn("block", F.concat_ws("\n", "block", "rest"))
    fields = ["path", "source_file", "start", "pos", "stamp", "block"]
    last = last.withColumn("stamp", F.when(F.col("timed"), F.col("stamp")).otherwise(F.col("enter"))).select(*fields)
    enter = b.select("path", "start", "enter")
    inner = events.where("NOT edge")
    if borders.count() <= MOST_SPLITS:
        inner = inner.join(F.broadcast(enter), ["path", "start"]).withColumn("stamp", F.when(F.col("timed"), F.col("stamp")).otherwise(F.col("enter"))).select(*fields)
    else:
        late = inner.where("NOT timed").drop("stamp").join(enter, ["path", "start"]).withColumnRenamed("enter", "stamp")
        inner = inner.where("timed").select(*fields).unionByName(late.select(*fields))
    stamp = F.regexp_replace(F.regexp_replace("stamp", r"^[A-Za-z]+\s+", ""), r"\s+", " ")
    blocks = inner.unionByName(last).withColumn("ts", F.try_to_timestamp(stamp, F.lit("dd MMMM yyyy HH:mm")).cast("timestamp_ntz")).where("ts IS NOT NULL")
    if with_path:  # in place of the file's name
        return _channels(blocks.select(F.col("path").alias("source_file"), F.col("start").alias("ts_pos"), F.col("pos").alias("block_pos"), "ts", "block"), sentinels)
    return _channels(blocks.select("source_file", F.col("start").alias("ts_pos"), F.col("pos").alias("block_pos"), "ts", "block"), sentinels)


def file_name(uri: Column) -> Column:
    """The name of a file from its URI."""
    return F.url_decode(F.replace(F.element_at(F.split(uri, "/"), -1), F.lit("+"), F.lit("%2B")))


def lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(path, source_file, start, line) of text files, split as Spark splits them; bytes that are no UTF-8 are replaced."""
    raw = spark.read.text(paths, **options)
    return raw.select(F.make_valid_utf8("value").alias("line"), F.col("_metadata.file_path").alias("path"), file_name(F.col("_metadata.file_path")).alias("source_file"), F.col("_metadata.file_block_start").alias("start"))


def read(spark: SparkSession, root: str, name_pattern: str = r"20(18|19|20|21)", exclude: str = "output.txt", **how) -> DataFrame:
    """Records of all matching *.txt under root; a large file is read by several tasks."""
    every = lines(spark, root, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return assembled(every.where(F.col("source_file").rlike(name_pattern) & (F.lower("source_file") != exclude)), **how)


def file_months(records: DataFrame) -> DataFrame:
    """(source_file, source_month): the month of each file's first timestamp."""
    return records.groupBy("source_file").agg(F.date_format(F.min_by("ts", F.struct("ts_pos", "block_pos")), "yyyy-MM").alias("source_month"))
