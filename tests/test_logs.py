"""Logs cut at any offset, incremental ingest that is broken off, diagrams in all kinds of PNG."""

import datetime as dt
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally import __main__ as cli
from flowtally.operators import detectors
from flowtally.sources import diagrams, records
from flowtally.streaming import ingest

LOG = """stray line 1=2
Int 9 1=1 before any time
Thursday 01 November 2018 00:15
 ignored 3=4
Int 1081    1=14    2=51    3=2046    4=0
 5=2047  6=NA  7=9

 7 = 10
Int 1093    1=24 2=52
Int 1094
Friday 99 November 2018 00:30
Int 5 1=1
  Friday\t02 November 2018 00:30\r
Int 1081 1=3\r
End of file 8=8
2=4
Int 1093 9=
 9
Saturday 03 November 2018 00:45
Int 7 1=1
Int 1081x 1=2 is no heading
"""


def rows(d, *more):
    return sorted((str(r.ts), r.site_id, sorted((k, -1 if v is None else v) for k, v in r.channels.items()), *[r[m] for m in more]) for r in d.collect())


WANT = [("2018-11-01 00:15:00", 1081, [(1, 14), (2, 51), (3, -1), (4, 0), (5, -1), (6, -1), (7, 10)]), ("2018-11-01 00:15:00", 1093, [(1, 24), (2, 52)]), ("2018-11-02 00:30:00", 1081, [(1, 3), (2, 4)]), ("2018-11-02 00:30:00", 1093, [(9, 9)]), ("2018-11-03 00:45:00", 7, [(1, 2)])]


@pytest.mark.parametrize("size", [None, 1, 2, 3, 5, 7, 11, 16, 23, 37, 50, 64, 90, 128, 200, 333])
def test_a_file_cut_anywhere(spark, tmp_path, size):
    (tmp_path / "Nov 2018 ü.txt").write_bytes(LOG.encode())
    (tmp_path / "Dec2018.txt").write_bytes(b"no heading\n1=2\n" * 9)
    (tmp_path / "Jan2019.txt").write_bytes(b"")
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"} if size else {}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        d = records.read(spark, str(tmp_path))
        if size and size < 64:
            assert d.rdd.getNumPartitions() > 3
        assert rows(d) == WANT
        first = records.file_months(d).collect()
        assert [(r.source_file, r.source_month) for r in first] == [("Nov 2018 ü.txt", "2018-11")]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_many_splits_join_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_SPLITS", 0)
    (tmp_path / "Nov2018.txt").write_text(LOG)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
        assert rows(records.read(spark, str(tmp_path))) == WANT
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_texts_of_whole_files_agree(spark):
    whole = records.parse(spark.createDataFrame([("a.txt", LOG)], "source_file string, value string"))
    assert rows(whole) == WANT


# --- incremental ingest ----------------------------------------------------------------------------------------------


def log(start: dt.datetime, level: int, n: int = 30) -> str:
    return "".join((start + dt.timedelta(minutes=15 * q)).strftime("%A %d %B %Y %H:%M\n") + f"Int 1 1={level + q} 2={level}\nInt 2 1=5\n" for q in range(n))


def state_of(spark, path):
    d = spark.read.parquet(path)
    return sorted(map(str, d.select(*sorted(d.columns)).collect()))


def test_follow(spark, tmp_path):
    """Files that come, change and go, and a run that breaks off after facts were written: always what one ingest of all gives."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    channels = spark.createDataFrame([(1, 1, "south", "true"), (1, 2, "north", "true")], "site_id int, channel_id int, approach string, operational string")
    s = cli.Settings()

    def put(name, text, age):
        (raw / name).write_text(text)
        os.utime(raw / name, (1_600_000_000 + age, 1_600_000_000 + age))

    def whole():
        at = str(tmp_path / f"whole{random.random()}")
        cli.ingest(spark, str(raw), channels, at, s)
        return state_of(spark, f"{at}/fact")

    put("A 2019.txt", log(dt.datetime(2019, 1, 1), 10), 0)
    put("B2019.txt", log(dt.datetime(2019, 2, 1), 20), 0)
    cli.follow(spark, str(raw), channels, out, s)
    assert state_of(spark, f"{out}/fact") == whole()
    at = {r.year_month: r.batch for r in spark.read.parquet(f"{out}/state/files").collect()}
    assert ingest.note_arrivals(spark, str(raw), f"{out}/state") == 0  # nothing came
    put("A 2019.txt", log(dt.datetime(2019, 1, 1), 11), 60)  # changed
    put("C2019.txt", log(dt.datetime(2019, 2, 10), 70), 0)  # another file of a month that is there
    put("D2019.txt", log(dt.datetime(2019, 3, 1), 40), 0)
    cli.follow(spark, str(raw), channels, out, s)
    assert state_of(spark, f"{out}/fact") == whole() and len(at) == 2

    put("D2019.txt", log(dt.datetime(2019, 4, 1), 40), 60)  # its month is another one now
    (raw / "B2019.txt").unlink()
    ingest.note_arrivals(spark, str(raw), f"{out}/state")

    def broken(*args):
        ingest.replace_months(*args)
        ingest.delete(spark, f"{out}/state/files/batch={args[1]}")  # as if it ended before this was written
        raise RuntimeError("lost")

    q = ingest.follow(spark, channels, f"{out}/state", out, s.minimum_detector_coverage, apply=broken)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination()
    cli.follow(spark, str(raw), channels, out, s)
    assert state_of(spark, f"{out}/fact") == whole()
    months = {str(r[0]) for r in spark.read.parquet(f"{out}/fact").select("year_month").distinct().collect()}
    assert months == {"2019-01", "2019-02", "2019-04"}
    assert spark.read.parquet(f"{out}/tables/source_quality").count() == 3
    (raw / "A 2019.txt").unlink()
    cli.follow(spark, str(raw), channels, out, s)
    assert state_of(spark, f"{out}/fact") == whole()


# --- diagrams --------------------------------------------------------------------------------------------------------


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def png(pixels, colour, depth, laced=False, palette=None, filters=(0, 1, 2, 3, 4)):
    """A PNG of samples (h, w, channels), with all filters in turn, by the letter of the format."""
    h, w, channels = pixels.shape
    step = max(1, channels * depth // 8)
    body, k = b"", 0
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if laced else ((0, 0, 1, 1),)
    for x, y, dx, dy in passes:
        part = pixels[y::dy, x::dx]
        if not part.size:
            continue
        above = None
        for line in part:
            bits = "".join(f"{v:0{depth}b}" for v in line.reshape(-1))
            raw = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
            above = above or bytes(len(raw))
            kind, out = filters[k % len(filters)], []
            k += 1
            for i, v in enumerate(raw):
                a, b, c = raw[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                out.append((v - (0, a, b, (a + b) // 2, paeth(a, b, c))[kind]) % 256)
            body += bytes([kind, *out])
            above = raw
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    packed = zlib.compress(body)
    extra = chunk(b"PLTE", palette) if palette else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(laced))) + extra + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize("colour, depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_png(colour, depth, laced):
    r = np.random.default_rng(colour * 100 + depth)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    samples = r.integers(0, 1 << depth, (13, 11, channels))
    colours = r.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
    got = diagrams.png_pixels(png(samples, colour, depth, laced, colours.tobytes() if colour == 3 else None))
    eight = samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1)) if colour == 0 else samples
    want = colours[samples[..., 0]] if colour == 3 else np.repeat(eight[..., :1], 3, 2) if colour in (0, 4) else eight[..., :3]
    assert (got == want).all()


def test_png_file_and_errors():
    p = np.random.default_rng(1).integers(0, 256, (9, 5, 3)).astype(np.uint8)
    assert (diagrams.png_pixels(diagrams.png_file(p)) == p).all()
    with pytest.raises(ValueError):
        diagrams.png_pixels(b"GIF89a")


def brute_outlines(mask):
    """Outer borders and borders of holes by filling from seeds, pixel by pixel."""
    h, w = mask.shape
    seen, out = np.zeros((h + 2, w + 2), bool), []
    m = np.pad(mask, 1)
    near = {True: [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], False: [(0, 1), (1, 0), (0, -1), (-1, 0)]}
    for y in range(h + 2):
        for x in range(w + 2):
            if seen[y, x]:
                continue
            kind, todo, part = m[y, x], [(y, x)], set()
            seen[y, x] = True
            while todo:
                p, q = todo.pop()
                part.add((p, q))
                for a, b in near[bool(kind)]:
                    u, v = p + a, q + b
                    if 0 <= u < h + 2 and 0 <= v < w + 2 and not seen[u, v] and m[u, v] == kind:
                        seen[u, v] = True
                        todo.append((u, v))
            if kind:
                free, todo = set(), [(-1, -1)]
                while todo:  # what can be reached from outside
                    p, q = todo.pop()
                    if (p, q) in free or (p, q) in part or not (-1 <= p <= h + 2 and -1 <= q <= w + 2):
                        continue
                    free.add((p, q))
                    todo += [(p + a, q + b) for a, b in near[False]]
                part = {(p, q) for p in range(h + 2) for q in range(w + 2)} - free
            elif (0, 0) in part:
                continue
            else:
                part |= {(p + a, q + b) for p, q in part for a, b in near[False]}
            ys, xs = [p for p, _ in part], [q for _, q in part]
            cells = [sum((p + a, q + b) in part for a in (0, 1) for b in (0, 1)) for p in range(min(ys), max(ys)) for q in range(min(xs), max(xs))]
            out.append((min(xs) - 1, min(ys) - 1, max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, sum(c == 4 for c in cells) + 0.5 * sum(c == 3 for c in cells)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_outlines(seed):
    r = np.random.default_rng(seed)
    mask = r.random((17, 23)) < (0.2, 0.5, 0.7, 0.85)[seed % 4]
    if seed > 3:
        mask = np.repeat(np.repeat(mask, 2, 0), 3, 1)
    assert sorted(diagrams.outlines(mask, 1, 10_000)) == brute_outlines(mask)
    assert diagrams.outlines(np.zeros((4, 4), bool)) == []


def page(*boxes, size=(500, 900)):
    p = np.full((*size, 3), 255, np.uint8)
    for x, y, w, h, colour in boxes:
        p[y : y + h, x : x + w] = colour
    return p


BLUE, GREEN, RED, WHITE = (0, 0, 255), (0, 255, 0), (255, 0, 0), (255, 255, 255)


def test_box_centres():
    p = page((400, 100, 24, 24, BLUE), (500, 100, 30, 26, GREEN), (503, 103, 24, 20, WHITE), (600, 100, 22, 22, BLUE), (650, 100, 36, 20, BLUE), (700, 100, 24, 24, RED), (371, 200, 24, 24, GREEN), (370, 300, 24, 24, GREEN), (100, 300, 24, 24, GREEN), (700, 300, 80, 80, BLUE), (720, 320, 24, 24, WHITE), (800, 300, 12, 24, BLUE), (812, 300, 12, 24, GREEN))
    # A 22 by 22 box has an area of 441; the hole of the large one has its border around it; touching colours are one box.
    assert diagrams.box_centres(p) == [(383.0, 212.0), (412.0, 112.0), (515.0, 113.0), (732.0, 332.0), (812.0, 312.0)]


def test_diagrams_of_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "1001.png").write_bytes(diagrams.png_file(page((680, 400, 24, 24, BLUE), (680, 200, 24, 24, GREEN), (400, 340, 24, 24, BLUE))))
    (tmp_path / "1002.png").write_bytes(diagrams.png_file(page()))
    (tmp_path / "plan.png").write_bytes(b"none")
    d = diagrams.read(spark, str(tmp_path))
    assert {r.site: [tuple(b) for b in r.boxes] for r in d.collect()} == {1001: [(412.0, 352.0), (692.0, 212.0), (692.0, 412.0)], 1002: []}
    counts = {r.site: tuple(r)[1:] for r in detectors.diagram_counts(d).collect()}
    assert counts == {1001: (3, 1, 1, 1, 0), 1002: (0, 0, 0, 0, 0)}
    assert diagrams.each(d).count() == 3
    (tmp_path / "1003.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    with pytest.raises(Exception, match="site 1003"):
        diagrams.read(spark, str(tmp_path)).collect()


def test_metadata_from_diagrams(spark, tmp_path, monkeypatch):
    """Logs and diagrams alone give the channels' sides; a diagram without boxes is one all the same."""
    raw, drawn, out = tmp_path / "raw", tmp_path / "drawn", str(tmp_path / "out")
    raw.mkdir()
    drawn.mkdir()
    (raw / "May2020.txt").write_text("".join(f"Friday 01 May 2020 {q // 4:02d}:{q % 4 * 15:02d}\nInt 5 1=4 2=6 3=8\nInt 6 7=9\n" for q in range(96)))
    (drawn / "5.png").write_bytes(diagrams.png_file(page((680, 400, 24, 24, BLUE), (680, 450, 24, 24, GREEN), (400, 340, 24, 24, BLUE))))
    (drawn / "8.png").write_bytes(diagrams.png_file(page()))
    (tmp_path / "settings.json").write_text('{"operational_readings": 50}')
    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main(["metadata", "--raw", str(raw), "--out", out, "--settings", str(tmp_path / "settings.json"), "--diagrams", str(drawn)])
    d = {(r.site, r.channel): r.approach for r in spark.read.parquet(f"{out}/detectors").collect()}
    assert d == {(5, 1): "south", (5, 2): "south", (5, 3): "west", (6, 7): "unknown"}
    assert {r.site: r.has_diagram for r in spark.read.parquet(f"{out}/inventory").collect()} == {5: True, 6: False, 8: True}


def test_holes_of_a_winding_shape():
    """Holes are found in time in proportion to the image, however long the way from outside is."""
    import time

    wall = np.zeros((401, 401), bool)
    wall[::2] = True
    wall[1::4, 0] = wall[3::4, -1] = True  # what is free winds through the rows
    wall[100, 199:202] = wall[102, 199:202] = wall[101, [199, 201]] = True
    wall[101, 300:303] = [True, False, True]
    begun = time.perf_counter()
    filled = diagrams._filled(wall)
    assert time.perf_counter() - begun < 2 and filled[101, 301] and filled[101, 200] and not filled[1, 200]
