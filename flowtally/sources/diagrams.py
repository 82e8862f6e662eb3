"""Junction diagrams: PNG files to the places of the boxes that stand for detectors, one image a row."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The colours of a box (red, green, blue), where the legend ends, extents and least area of a box, and how near two centres are one.
COLOURS = ((0, 0, 255), (0, 255, 0))
LEGEND, SHORTEST, LONGEST, AREA, SAME = 370, 14, 35, 450, 3

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Passes of an interlaced image: first column and row, steps.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(data: bytes, at: int, rows: int, size: int, step: int) -> tuple[np.ndarray, int]:
    """`rows` lines of `size` bytes from data[at:], their filters undone; step is a pixel's bytes."""
    out = np.zeros((rows + 1, size), np.uint8)
    lines = np.frombuffer(data, np.uint8, rows * (size + 1), at).reshape(rows, size + 1)
    at += rows * (size + 1)
    kinds, out[1:] = lines[:, 0], lines[:, 1:]
    left = np.flatnonzero(kinds == 1)  # these hang on no other line, so all are undone at once
    for c in range(step if len(left) else 0):
        out[1 + left, c::step] = np.cumsum(lines[left, 1 + c :: step], axis=1, dtype=np.uint8)
    for y in (np.flatnonzero(kinds > 1) + 1).tolist():
        kind, line, above = int(kinds[y - 1]), lines[y - 1, 1:], out[y - 1]
        if kind == 2:
            out[y] = line + above
        elif kind in (3, 4):  # each byte hangs on the one before it
            got, up = bytearray(step) + bytearray(line.tobytes()), bytes(step) + above.tobytes()
            for k in range(step, size + step):
                a, b, c = got[k - step], up[k], up[k - step]
                if kind == 3:
                    near = (a + b) >> 1
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                got[k] = (got[k] + near) & 255
            out[y] = np.frombuffer(got, np.uint8)[step:]
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:], at


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """Lines of bytes as (rows, width, channels) samples; of 16 bits the upper 8."""
    if depth == 16:
        return lines.reshape(len(lines), width, channels, 2)[..., 0]
    if depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * channels * depth].reshape(len(lines), width, channels, depth)
        return bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return lines.reshape(len(lines), width, channels)


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes of a PNG file: any colour type and depth, interlaced or not; transparency plays no part."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
    width, height, depth, colour, _, _, laced = head
    raw, channels = zlib.decompress(b"".join(body)), _CHANNELS[colour]
    step, at = max(1, channels * depth // 8), 0
    out = np.zeros((height, width, channels), np.uint8)
    for x, y, dx, dy in _PASSES if laced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            lines, at = _unfiltered(raw, at, h, -(-w * channels * depth // 8), step)
            out[y::dy, x::dx] = _samples(lines, w, depth, channels)
    if colour == 3:
        return palette[out[..., 0]]
    if colour in (0, 4):
        grey = out[..., :1] * (255 // ((1 << depth) - 1) if depth < 8 else 1)
        return np.repeat(grey.astype(np.uint8), 3, 2)
    return out[..., :3]


def png_file(pixels: np.ndarray, filters: tuple[int, ...] = (0, 1, 2)) -> bytes:
    """(height, width, 3) bytes as a PNG file, whose lines take the filters none, left and above in turn."""
    height, width, _ = pixels.shape
    flat = pixels.reshape(height, -1)
    kinds, lines = np.resize(np.array(filters, np.uint8), height), flat.copy()
    left, above = kinds == 1, np.flatnonzero(kinds == 2)
    lines[left, 3:] -= flat[left, :-3]
    above = above[above > 0]
    lines[above] -= flat[above - 1]
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    body = zlib.compress(np.concatenate([kinds[:, None], lines], 1).tobytes(), 1)
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last) of all runs of set pixels, by rows."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, a = np.divmod(np.flatnonzero(edge == 1), edge.shape[1])
    return y, a, np.flatnonzero(edge == -1) % edge.shape[1]


def _parts(y: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """A label for each run: those of neighbouring rows that share a column (reach 0), or also a corner (reach 1), are one part."""
    up = list(range(len(y)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    rows = np.searchsorted(y, np.arange(int(y.max()) + 2)) if len(y) else np.zeros(1, int)
    first, last = a.tolist(), b.tolist()
    for r in range(len(rows) - 2):
        i, j = int(rows[r]), int(rows[r + 1])
        ends = j, int(rows[r + 2])
        while i < ends[0] and j < ends[1]:
            if first[i] < last[j] + reach and first[j] < last[i] + reach:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
            if last[i] < last[j]:
                i += 1
            else:
                j += 1
    return np.array([root(k) for k in range(len(up))], int)


def _filled(part: np.ndarray) -> np.ndarray:
    """A mask with its holes: what can't be reached from outside over edges."""
    free = ~np.pad(part, 1)
    y, a, b = _runs(free)
    label = _parts(y, a, b, 0)
    out = ~free
    for k in np.flatnonzero(label != label[0]).tolist():  # the first run is outside
        out[y[k], a[k] : b[k]] = True
    return out[1:-1, 1:-1]


def outline_area(shape: np.ndarray) -> float:
    """The area inside the line through the centres of a shape's border pixels: whole cells between four of its pixels, and
    half of those between three."""
    p = np.pad(shape, 1).astype(np.int8)
    k = p[1:, 1:] + p[1:, :-1] + p[:-1, 1:] + p[:-1, :-1]
    return float((k == 4).sum() + 0.5 * (k == 3).sum())


def outlines(mask: np.ndarray, least: int = SHORTEST, most: int = LONGEST) -> list[tuple[int, int, int, int, float]]:
    """(x, y, width, height, area) of the outer border of every part of a mask (pixels that touch by edge or corner), and of the
    border around every hole, as far as both extents are between least and most."""
    out = []
    for wide, reach in ((mask, 1), (~np.pad(mask, 1), 0)):
        y, a, b = _runs(wide)
        label = _parts(y, a, b, reach)
        if reach == 0:
            y, a, b = y - 1, a - 1, b - 1
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        for k in np.split(order, cuts) if len(order) else ():
            x0, x1, y0, y1 = int(a[k].min()), int(b[k].max()), int(y[k].min()), int(y[k].max()) + 1
            grow = 1 - reach  # the border of a hole is the set pixels around it
            w, h = x1 - x0 + 2 * grow, y1 - y0 + 2 * grow
            if not (least <= w <= most and least <= h <= most) or (grow and x0 < 0):
                continue
            shape = np.zeros((h, w), bool)
            for r, s, e in zip(y[k] - y0 + grow, a[k] - x0 + grow, b[k] - x0 + grow, strict=True):
                shape[r, s:e] = True
            if grow:
                ring = np.pad(shape, 1)
                shape |= ring[2:, 1:-1] | ring[:-2, 1:-1] | ring[1:-1, 2:] | ring[1:-1, :-2]
            else:
                shape = _filled(shape)
            out.append((x0 - grow, y0 - grow, w, h, outline_area(shape)))
    return out


def box_centres(pixels: np.ndarray) -> list[tuple[float, float]]:
    """Centres of the boxes of an image, from left to right: parts of the boxes' colours, or holes in them, right of the legend and of
    a box's size. Of centres that are nearly the same the first counts."""
    mask = np.zeros(pixels.shape[:2], bool)
    for c in COLOURS:
        mask |= (pixels[..., 0] == c[0]) & (pixels[..., 1] == c[1]) & (pixels[..., 2] == c[2])
    out: list[tuple[float, float]] = []
    for x, y, w, h, area in sorted(outlines(mask)):
        at = x + w / 2.0, y + h / 2.0
        if x > LEGEND and area > AREA and not any(abs(at[0] - p) < SAME and abs(at[1] - q) < SAME for p, q in out):
            out.append(at)
    return out


def boxes(images: DataFrame) -> DataFrame:
    """(site, boxes) of images (site, content: bytes of PNG files): boxes is an array of (x, y), empty where none is found. An image that
    is no PNG is an error that names the site. Images are looked at one by one where they are; nothing is shuffled."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        for b in batches:
            for site, data in zip(b["site"].to_pylist(), b["content"], strict=True):
                try:
                    found = box_centres(png_pixels(data.as_py()))
                except (ValueError, KeyError, TypeError, zlib.error, struct.error) as e:
                    raise ValueError(f"the diagram of site {site} can't be read: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([site], pa.int64()), pa.array([[{"x": x, "y": y} for x, y in found]], kind)], ["site", "boxes"])

    return images.select(F.col("site").cast("long").alias("site"), "content").mapInArrow(look, "site long, boxes array<struct<x:double,y:double>>")


def read(spark: SparkSession, root: str) -> DataFrame:
    """(site, boxes) of all PNG files under root whose name is a number, that of the site."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root)
    name = F.regexp_extract("path", r"([^/]+)\.png$", 1)
    return boxes(files.where(name.rlike("^[0-9]+$")).select(name.cast("long").alias("site"), "content"))


def each(diagrams: DataFrame) -> DataFrame:
    """(site, x, y): a row for each box."""
    return diagrams.select("site", F.inline("boxes"))
