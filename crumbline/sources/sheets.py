"""Cells of workbooks: one row per filled cell, read by Spark from the workbook files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def cells_of(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of a workbook, rows and columns from 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", NS)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", NS)]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", NS)]
        for i, name in enumerate(names, 1):
            for c in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iterfind(".//m:c", NS):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                column = 0
                for x in letters:
                    column = 26 * column + ord(x) - 64
                v, kind = c.find("m:v", NS), c.get("t")
                text = "".join(t.text or "" for t in c.iterfind(".//m:t", NS)) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                if text:
                    yield name, int(row), column, text


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, r, c, v) of all workbooks at path; a file is read by one task."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for p, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(p, *x) for x in cells_of(bytes(content))], columns=["path", "sheet", "r", "c", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, r int, c int, v string")


PARTS = "path string, sheet string, part string, ref string, r int, c int, kind string, v string, f string"


def _place(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for x in letters:
        column = 26 * column + ord(x) - 64
    return int(row), column


def _moved(formula: str, down: int, right: int) -> str:
    """A formula as it reads in another cell: references without a dollar sign move along, quoted texts and names of sheets don't."""

    def one(m: re.Match) -> str:
        if m["quoted"]:
            return m[0]
        row, column = _place(m["column"] + m["row"])
        column, name = column if m["fix"] else column + right, ""
        while column > 0:
            column, rest = divmod(column - 1, 26)
            name = chr(65 + rest) + name
        return f"{m['fix']}{name}{m['fix_row']}{row if m['fix_row'] else row + down}"

    return re.sub(r"""(?P<quoted>"(?:[^"]|"")*"|'(?:[^']|'')*'|[A-Za-z0-9_.]+!)|(?<![A-Za-z0-9_.$])(?P<fix>\$?)(?P<column>[A-Z]{1,3})(?P<fix_row>\$?)(?P<row>\d+)(?![A-Za-z0-9_(!])""", one, formula)


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Styles that show numbers as dates or times (fixed values: the format's built-in numbers)."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode")) for f in root.iterfind(".//m:numFmts/m:numFmt", NS)}
    dates = {*range(14, 23), *range(45, 48)} | {n for n, code in own.items() if re.search("[dmyhs]", code.lower())}
    return {i for i, x in enumerate(root.iterfind("./m:cellXfs/m:xf", NS)) if int(x.get("numFmtId", 0)) in dates}


def parts_of(content: bytes) -> Iterator[tuple]:
    """(sheet, part, ref, r, c, kind, v, f) of a workbook. A cell's kind is number, date, bool, error, text or blank (a formula without a stored result), f its formula with
    the equals sign; of formulas that cells share each cell gets its own. Further parts: sheet (v: visible, hidden or veryHidden), merged (ref: the range), hidden row
    (r) and hidden column (c, one for each)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", NS)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", NS)]
        dates = _date_styles(z)
        for i, about in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", NS), 1):
            name, page, masters = about.get("name"), ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")), {}
            yield name, "sheet", None, None, None, None, about.get("state", "visible"), None
            for m in page.iterfind(".//m:mergeCell", NS):
                yield name, "merged", m.get("ref"), None, None, None, None, None
            for x in page.iterfind(".//m:cols/m:col", NS):
                if x.get("hidden") in ("1", "true") or float(x.get("width", 1)) == 0:
                    for c in range(int(x.get("min")), int(x.get("max")) + 1):
                        yield name, "hidden column", None, None, c, None, None, None
            for x in page.iterfind(".//m:row", NS):
                if x.get("r") and (x.get("hidden") in ("1", "true") or float(x.get("ht", 1)) == 0):
                    yield name, "hidden row", None, int(x.get("r")), None, None, None, None
            for c in page.iterfind(".//m:c", NS):
                row, column = _place(c.get("r"))
                v, f, kind = c.find("m:v", NS), c.find("m:f", NS), c.get("t", "n")
                text = "".join(t.text or "" for t in c.iterfind(".//m:is//m:t", NS)) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                formula = None
                if f is not None:
                    formula = f.text
                    if f.get("t") == "shared" and formula:
                        masters[f.get("si")] = (formula, row, column)
                    elif f.get("t") == "shared" and f.get("si") in masters:
                        first, r0, c0 = masters[f.get("si")]
                        formula = _moved(first, row - r0, column - c0)
                    formula = "=" + formula if formula else None
                if text is None and formula is None:
                    continue
                label = "blank" if text is None else {"b": "bool", "e": "error", "d": "date", "n": "date" if int(c.get("s", 0)) in dates else "number"}.get(kind, "text")
                yield name, "cell", c.get("r"), row, column, label, text, formula


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Everything that a profile of workbooks needs, a row for each part, with the workbook's path; a file is read by one task. No sheet is cut."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PARTS.split(", ")]
        for pdf in pdfs:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = pd.DataFrame([(p, *x) for x in parts_of(bytes(content))], columns=names)
                yield rows.astype({"r": "Int32", "c": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PARTS)


def dated_sheets(cells: DataFrame, year: int) -> DataFrame:
    """Cells of sheets that are named after a day, such as "May 8", with the day as d."""
    return cells.withColumn("d", _day(cells["sheet"], year)).where("d is not null")


def _day(name, year: int):
    from pyspark.sql import functions as F

    clean = F.trim(name)
    return F.when(clean.rlike(r"^[A-Z][a-z]{2} \d{1,2}$"), F.to_date(F.try_to_timestamp(F.concat(clean, F.lit(f" {year}")), F.lit("MMM d yyyy"))))
