"""Workbooks: the first sheet of XLSX files as rows, and reports as workbooks with totals and merged cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from haulspark.operators.grouped import Rows, walk_groups
from haulspark.sources.shipping import ship_package

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def column_name(n: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> list[tuple[int, list[str | None]]]:
    """(row number, cells as text) of the first sheet; empty cells before the last are None, rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        tree = lambda name: ElementTree.fromstring(archive.read(name))
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{{{_MAIN}}}t"))
        shared = [text(item) for item in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        first = tree("xl/workbook.xml").find(f"{{{_MAIN}}}sheets")[0].get(f"{{{_LINKS}}}id")
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        path = targets[first].lstrip("/")
        sheet = tree(path if path in names else f"xl/{path}")
    out = []
    for at, row in enumerate(sheet.iter(f"{{{_MAIN}}}row"), 1):
        cells: list[str | None] = []
        for cell in row:
            place = _column_number(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (place - len(cells))
            value, kind = cell.find(f"{{{_MAIN}}}v"), cell.get("t")
            if kind == "inlineStr":
                cells.append(text(cell))
            elif value is None or value.text is None:
                cells.append(None)
            else:
                cells.append(shared[int(value.text)] if kind == "s" else ("true" if value.text == "1" else "false") if kind == "b" else value.text)
        if any(c not in (None, "") for c in cells):
            out.append((int(row.get("r") or at), cells))
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_no, cells`` of the first sheet of XLSX files, each file read whole in one task."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = sheet_rows(content)
                if rows:
                    yield pd.DataFrame({"file": file.rsplit("/", 1)[-1], "row_no": [n for n, _ in rows], "cells": [c for _, c in rows]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, row_no int, cells array<string>")


def _cell(place: str, value: object, style: int = 0) -> str:
    style_text = f' s="{style}"' if style else ""
    if value is None or value != value:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{place}"{style_text}><v>{value!r}</v></c>'
    return f'<c r="{place}" t="inlineStr"{style_text}><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(header: Sequence[str], rows: Sequence[Sequence[object]], totals: dict[int, float], spans: Sequence[tuple[int, int, int]]) -> bytes:
    """One workbook of a header, rows, a line of ``totals`` by column and merged ``spans`` (column, first row, last row, from 0 within the rows)."""
    lines = ["".join(_cell(f"{column_name(i)}1", name, 1) for i, name in enumerate(header))]
    for n, row in enumerate(rows, 2):
        lines.append("".join(_cell(f"{column_name(i)}{n}", v, 2 if isinstance(v, float) else 0) for i, v in enumerate(row)))
    if totals:
        n = len(rows) + 2
        lines.append("".join(_cell(f"{column_name(i)}{n}", "Total" if i == 0 and i not in totals else totals.get(i), 3) for i in range(len(header))))
    data = "".join(f'<row r="{n}">{cells}</row>' for n, cells in enumerate(lines, 1))
    merges = "".join(f'<mergeCell ref="{column_name(c)}{a + 2}:{column_name(c)}{b + 2}"/>' for c, a, b in spans)
    sheet = f'<worksheet xmlns="{_MAIN}"><sheetData>{data}</sheetData>{f"<mergeCells count=\"{len(spans)}\">{merges}</mergeCells>" if spans else ""}</worksheet>'
    styles = (
        f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="4"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="4" applyNumberFormat="1"/><xf fontId="1" numFmtId="4" applyFont="1" applyNumberFormat="1"/></cellXfs></styleSheet>'
    )
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets><sheet name="Raport" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINKS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_LINKS}/styles" Target="styles.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet, "xl/styles.xml": styles,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in parts.items():
            archive.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return out.getvalue()


def workbooks(rows: DataFrame, report: str, columns: Sequence[str], order: Sequence[str], totals: Sequence[str] = (), merged: Sequence[str] = ()) -> DataFrame:
    """``report, content``: one workbook a report, its rows in ``order``, with a line of totals and neighbouring equal cells of ``merged`` columns made one.

    A report is a selection, which has a limit. Blank cells are not merged; a column without any number has no total.
    """

    def walk(key: object, cells: Rows) -> list[tuple]:
        table = list(zip(*(cells[c] for c in columns), strict=True))
        sums = {}
        for c in totals:
            numbers = [float(v) for v in cells[c] if v is not None and v == v]
            if numbers:
                sums[list(columns).index(c)] = round(sum(numbers), 4)
        spans = []
        for c in merged:
            at, first = list(columns).index(c), 0
            for n in range(1, len(table) + 1):
                if n < len(table) and table[n][at] == table[first][at] and table[first][at] not in (None, ""):
                    continue
                if n - first > 1:
                    spans.append((at, first, n - 1))
                first = n
        return [(key, workbook(columns, table, sums, spans))]

    kind = dict(rows.dtypes)[report]
    return walk_groups(rows.select(report, *[c for c in dict.fromkeys([*columns, *order]) if c != report]), report, order, walk, f"{report} {kind}, content binary")
