"""Spreadsheets: sheets of an XLSX workbook as rows, and rows as a workbook."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = "file string, sheet string, row int, cells map<int,string>"
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> dict[str, list[dict[int, str]]]:
    """Cells of every sheet by row, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet"):
            target = targets[sheet.get(REL)].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{NS}row"):
                cells = {}
                for at, c in enumerate(row.iter(f"{NS}c")):
                    v = c.find(f"{NS}v")
                    text = "".join(t.text or "" for t in c.iter(f"{NS}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    if text is not None:
                        cells[_column(c.get("r")) if c.get("r") else at] = text
                rows.append(cells)
            out[sheet.get("name")] = rows
        return out


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``CELLS`` from every workbook at ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for name, rows in sheets(bytes(content)).items():
                    yield pd.DataFrame([(file, name, i, r) for i, r in enumerate(rows)], columns=["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet as a table of text, its first row the header; ``ValueError`` if it is not there."""
    from pyspark.sql import functions as F

    cells = read_cells(spark, path)
    head = cells.where((F.col("sheet") == sheet) & (F.col("row") == 0)).select("cells").first()
    if head is None:
        raise ValueError(f"no sheet {sheet!r} in {path}")
    body = cells.where((F.col("sheet") == sheet) & (F.col("row") > 0))
    return body.select(*[F.col("cells")[i].alias(n) for i, n in sorted(head["cells"].items())])


def workbook(tables: dict[str, pd.DataFrame]) -> bytes:
    """A workbook of small report tables."""
    buffer = io.BytesIO()

    def cell(v) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(tables)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="s{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS[1:-1]}" xmlns:r="{REL[1:-3]}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="s{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        for i, n in enumerate(names):
            t = tables[n]
            rows = [list(t.columns), *t.itertuples(index=False)]
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{NS[1:-1]}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return buffer.getvalue()
