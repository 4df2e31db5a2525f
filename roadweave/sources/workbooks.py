"""Spreadsheets (zipped XML) as tables: files come through Spark's reader of binary files, so they may lie in any store; a file is one task's."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sheets that hold each asset's costs, the first that is there.
COST_SHEETS = {"road": ("roads",), "tunnel": ("tunnels", "roads"), "bridge_surface": ("bridges-surface", "bridges"), "bridge_river": ("bridges-river", "bridges")}
#: XML names of the format.
MAIN, REL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a sheet in a batch.
ROWS = 10_000
COLUMNS = ["path", "sheet", "row", "head", "cells"]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def parse(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, texts of its cells) of a workbook's rows; cells that are missing or empty are null. Other files raise ValueError."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        sheets = [(s.get("name"), s.get(f"{REL}id")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        files = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    except (zipfile.BadZipFile, KeyError) as e:
        raise ValueError("no workbook") from e
    shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
    for name, key in sheets:
        target = files[key]
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            number = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = cell.findtext(f"{MAIN}v")
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = _text(cell)
                    cells[at] = value if value not in ("", None) else None
                yield name, number, cells
                row.clear()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, head (whether it is its sheet's first), cells (array of texts): all rows of all sheets of a file, folder or glob of workbooks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                seen: set[str] = set()
                rows = []
                for sheet, row, cells in parse(content):
                    rows.append((p, sheet, row, sheet not in seen, cells))
                    seen.add(sheet)
                    if len(rows) == ROWS:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
                yield pd.DataFrame(rows, columns=COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, head boolean, cells array<string>")


def read_workbook(spark: SparkSession, path: str, sheets: Iterable[str]) -> DataFrame:
    """The first of ``sheets`` that the workbooks have, all columns as texts, named by their first row, trimmed and in small letters.

    Rows without any value are left out; a column without name is column_N; workbooks without any of the sheets raise
    ValueError. Of several workbooks the first header, by path, names the columns.
    """
    names = list(sheets)
    cells = read_cells(spark, path).where(F.col("sheet").isin(names))
    heads = cells.where("head").groupBy("sheet").agg(F.min_by("cells", "path").alias("cells")).collect()  # a row a sheet that is asked for
    found = {h["sheet"]: h["cells"] for h in heads}
    sheet = next((n for n in names if n in found), None)
    if sheet is None:
        raise ValueError(f"{path} has none of the sheets {', '.join(names)}")
    columns = [(c or "").strip().lower() or f"column_{i + 1}" for i, c in enumerate(found[sheet])]
    rows = cells.where((F.col("sheet") == sheet) & ~F.col("head") & F.exists("cells", lambda c: c.isNotNull()))
    return rows.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """asset, key, low, high of a cost workbook, as ``damages.damage_costs`` takes them: columns label, min, max of COST_SHEETS; rows without label go."""
    out = None
    for asset, sheets in COST_SHEETS.items():
        rows = read_workbook(spark, path, sheets)
        one = rows.where("label IS NOT NULL").select(F.lit(asset).alias("asset"), F.trim("label").alias("key"), F.col("min").try_cast("double").alias("low"), F.col("max").try_cast("double").alias("high"))
        out = one if out is None else out.union(one)
    return out
