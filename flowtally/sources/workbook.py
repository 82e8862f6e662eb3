"""Site registry from an XLSX workbook, which is a zip of XML parts; read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> list[tuple[str, dict[int, dict[int, float | str]]]]:
    """(name, rows) of each sheet; rows maps a row's number to its cells by column from 0. Empty cells are absent."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name))
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
        shared = [text(e) for e in part("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        target = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
        out = []
        for s in part("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            at = target[s.get(_REL)]
            rows: dict[int, dict[int, float | str]] = {}
            number = 0
            for row in part(at.lstrip("/") if at.startswith("/") else f"xl/{at}").iter(f"{_MAIN}row"):
                number = int(row.get("r") or number + 1)
                got, k = {}, -1
                for c in row.iter(f"{_MAIN}c"):
                    k = _column(c.get("r")) if c.get("r") else k + 1
                    v = c.find(f"{_MAIN}v")
                    kind = c.get("t")
                    if kind == "inlineStr":
                        got[k] = text(c)
                    elif v is not None and v.text is not None:
                        got[k] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else float(v.text)
                rows[number] = got
            out.append((s.get("name"), rows))
        return out


def _whole(v: float | str | None) -> int | None:
    """A number without its fraction, or a text that is a whole number; else None."""
    if isinstance(v, str):
        return int(v) if re.fullmatch(r"\s*[+-]?[0-9]+\s*", v) else None
    return None if v is None else int(v)


def read_registry(spark: SparkSession, root: str, word: str = "scats") -> DataFrame:
    """(site, name, gis_id, registry_source) from the first workbook under root, by path, that has `word` in its name and is
    no lock file: its sheet with most rows, from the second row. Rows without a whole number in the first cell go; of a
    repeated site the first row counts. Registries are one small file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["name"], b["content"], strict=True):
                best = max((r for _, r in sheets(content)), key=lambda r: max(r, default=0), default={})
                for i, c in best.items():
                    site = _whole(c.get(0)) if i >= 2 else None
                    if site is not None:
                        label = c.get(1, "")
                        label = str(int(label) if isinstance(label, float) and label.is_integer() else label)
                        rows.append((name, i, site, label.strip(), _whole(c.get(2))))
            out = pd.DataFrame(rows, columns=["registry_source", "row", "site", "name", "gis_id"])
            yield out.astype({"gis_id": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(root)
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content").where(F.lower("name").contains(word) & ~F.col("name").startswith("~$"))
    rows = files.orderBy("path").limit(1).select("name", "content").mapInPandas(run, "registry_source string, row long, site long, name string, gis_id long")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("row"))).where("k = 1")
    return first.select("site", "name", "gis_id", "registry_source")
