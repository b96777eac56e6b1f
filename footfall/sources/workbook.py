"""Schedule workbooks (Office Open XML spreadsheets) as schedule grids.

Files are read as bytes by Spark, so they may lie in any store that it reads, a workbook to a task; sheets are parsed as a
stream of XML, row by row. Sheets whose names are all digits count, as years. The third row of a sheet is its header, where months are found by their exact
names; the rows below are the grid, with the slot in the first column and the team in the second. Cells are text as they are stored.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schemas
from footfall.config import MONTHS
from footfall.operators import schedule

#: Rows of a sheet before its grid, the last of them the header.
HEADER_ROWS = 3
#: Rows in a batch that a task gives out.
BATCH = 5000
#: Fixed value: the error if no sheet has a record.
NOTHING_PARSED = "No service records parsed from Excel file"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _texts(element: ElementTree.Element) -> str:
    """The text of a shared or inline string: its own or that of its runs, without phonetic hints."""
    parts = [element, *element.findall(f"{_MAIN}r")]
    return "".join(t.text or "" for p in parts for t in p.findall(f"{_MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        out = []
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_MAIN}si":
                out.append(_texts(e))
                e.clear()
        return out


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and member of each sheet, in the workbook's order."""
    related = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): posixpath.normpath(posixpath.join("/xl", r.get("Target"))).lstrip("/") for r in related}
    listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return [(s.get("name"), target[s.get(_RELATED)]) for s in listed]


def _column(reference: str) -> int:
    """The column of a cell such as ``AB12``, from 0."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def rows_of_sheet(book: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """Row numbers from 0 and their cells by column, of rows and cells that hold something."""
    number = -1
    with book.open(member) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            number = int(row.get("r")) - 1 if row.get("r") else number + 1
            cells, at = {}, -1
            for cell in row.findall(f"{_MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else at + 1
                kind, value, inline = cell.get("t"), cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}is")
                if kind == "inlineStr" and inline is not None:
                    cells[at] = _texts(inline)
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if kind == "s" else value.text
            row.clear()
            yield number, cells


def grid_rows(content: bytes, source_id: str) -> Iterator[tuple]:
    """Rows of the grid of each sheet that is named by digits."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        for name, member in sheets(book):
            if not (name.isascii() and name.isdigit()):
                continue
            at: dict[str, int] = {}
            for number, cells in rows_of_sheet(book, member, shared):
                if number == HEADER_ROWS - 1:
                    for column in sorted(cells, reverse=True):  # the first of equal names stays
                        at[cells[column]] = column
                elif number >= HEADER_ROWS:
                    yield (source_id, name, number, cells.get(0), cells.get(1), *(cells.get(at[m]) if m in at else None for m in MONTHS))


def read_workbooks(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """The schedule grids of all workbooks at ``path``; their source is ``source_id``, or the file's name without its ending."""
    files = spark.read.format("binaryFile").load(path)
    named = files.select(F.lit(source_id).alias("source") if source_id is not None else F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source"), "content")
    columns = [c.split()[0] for c in schemas.SCHEDULE_GRID.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["source"], batch["content"], strict=True):
                held = []
                for row in grid_rows(content, source):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=columns, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns, dtype=object)

    return named.mapInPandas(parse, schemas.SCHEDULE_GRID)


def read_service_records(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """Clean service records of all workbooks at ``path``; an error if no sheet of any has one."""
    records = schedule.parse_grid(read_workbooks(spark, path, source_id))
    if records.isEmpty():
        raise ValueError(NOTHING_PARSED)
    return schedule.clean_records(records)
