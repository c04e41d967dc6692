"""XLSX workbooks. Spark reads the files, so any store will do; each is unpacked by one task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import NULL_MARKERS
from ..plans.table import Key, Table, stored
from .delimited import header_names, infer, typed

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells as text) of all sheets, row by row."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = [_text(x) for x in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot().findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
    dates: set[int] = set()
    if "xl/styles.xml" in names:
        styles = ElementTree.parse(book.open("xl/styles.xml")).getroot()
        custom = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", x.get("formatCode", "")) for x in styles.iter(f"{{{_NS['m']}}}numFmt")}
        for i, xf in enumerate(styles.findall("m:cellXfs/m:xf", _NS)):
            k = int(xf.get("numFmtId", 0))
            if 14 <= k <= 22 or 45 <= k <= 47 or re.search("[ymdhs]", custom.get(k, ""), re.I):
                dates.add(i)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    for sheet in ElementTree.parse(book.open("xl/workbook.xml")).getroot().findall("m:sheets/m:sheet", _NS):
        target = targets[sheet.get(_REL)].lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        if path not in names:
            continue
        row_no = 0
        for _, node in ElementTree.iterparse(book.open(path)):
            if node.tag != f"{{{_NS['m']}}}row":
                continue
            cells: list[str | None] = []
            for c in node.findall("m:c", _NS):
                ref = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
                at = len(cells)
                if ref:
                    at = 0
                    for ch in ref[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                cells += [None] * (at - len(cells))
                kind, v = c.get("t", "n"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    value = _text(c)
                elif v is None or v.text is None:
                    value = None
                elif kind == "s":
                    value = shared[int(v.text)]
                elif kind == "b":
                    value = "true" if v.text == "1" else "false"
                elif kind == "e":
                    value = "ERROR"
                elif kind == "n" and int(c.get("s", 0)) in dates:
                    value = (datetime(1899, 12, 30) + timedelta(seconds=round(float(v.text) * 86400))).strftime("%Y-%m-%d %H:%M:%S")
                elif kind == "n":
                    number = float(v.text)
                    value = str(int(number)) if number.is_integer() and abs(number) < 1e15 else v.text
                else:
                    value = v.text
                cells.append(value)
            yield sheet.get("name"), row_no, cells
            row_no += 1
            node.clear()


def read_workbook(spark: SparkSession, path: str) -> dict[str, Table]:
    """A table for each sheet that has a row; the first row is the header. The file is unpacked and parsed once, by one
    task, and the rows of its sheets are stored: widths, types and all later use read those."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                batch: list[tuple] = []
                for row in sheet_rows(content):
                    batch.append(row)
                    if len(batch) == 5000:
                        yield pd.DataFrame(batch, columns=["sheet", "row", "cells"])
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=["sheet", "row", "cells"])

    rows = stored(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "sheet string, row long, cells array<string>"), "sheets")
    sheets = rows.groupBy("sheet").agg(F.max(F.size("cells")).alias("width"), F.min_by("cells", "row").alias("header")).collect()
    out = {}
    for s in sheets:
        if not s.width:
            continue
        header = [*(x or "" for x in s.header), *[""] * (s.width - len(s.header))]
        names = header_names(header)
        cell = [F.trim(F.get("cells", F.lit(i))) for i in range(s.width)]
        df = rows.filter((F.col("sheet") == s.sheet) & (F.col("row") > 0)).select(*(F.when(~c.isin(*NULL_MARKERS), c).alias(n) for c, n in zip(cell, names, strict=True)), F.col("row").alias("__o0"))
        out[s.sheet] = Table(typed(df, infer(df, names)), (Key("__o0"),))
    if not out:
        raise ValueError(f"{path}: no sheet has a row")
    return out
