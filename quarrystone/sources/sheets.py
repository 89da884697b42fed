"""Spreadsheets made for reading, as tables: every cell is a row, and a table is found in them by an anchor and by its stacked headers.

A workbook is a ZIP of XML; a task reads a workbook's parts as streams of events, so memory is that of its shared strings. What follows is joins and windows over
cells, and no sheet is brought together in one place but by its own key.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL = "path string, place int, sheet string, row int, column int, text string, number double"
#: Fixed by the format: where a part's relations are named.
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def column_of(reference: str) -> int:
    """'AB12' to 27: letters count in base 26 from A = 1, columns from 0."""
    n = 0
    for c in re.match(r"[A-Za-z]*", reference)[0].upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def strings(book: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if local(e.tag) == "si":
                    out.append("".join(t.text or "" for r in e for t in ([r] if local(r.tag) == "t" else r if local(r.tag) == "r" else []) if local(t.tag) == "t"))
                    e.clear()
    return out


def parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets, in the order of the workbook."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(e.tag) == "sheet"]
    places = [(e.get("name"), targets.get(e.get(RELATION)) or "") for e in sheets]
    return [(name, to.lstrip("/") if to.startswith("/") else f"xl/{to}") for name, to in places if "worksheets/" in to]


def cells_in(content: bytes) -> Iterator[tuple[int, str, int, int, str, float | None]]:
    """(place, sheet, row, column, text, number) of the cells that hold something; places, rows and columns from 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = strings(book)
        for place, (name, part) in enumerate(parts(book)):
            row = -1
            with book.open(part) as f:
                for event, e in ElementTree.iterparse(f, ("start", "end")):
                    kind = local(e.tag)
                    if kind == "row" and event == "start":
                        row, column = int(e.get("r") or row + 2) - 1, -1
                    elif kind == "c" and event == "end":
                        column = column_of(e.get("r")) if e.get("r") else column + 1
                        value = next((v.text for v in e if local(v.tag) == "v"), None)
                        text, number = value, None
                        if e.get("t") == "s" and value is not None:
                            text = shared[int(value)]
                        elif e.get("t") == "inlineStr":
                            text = "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")
                        elif e.get("t") == "b" and value is not None:
                            text = "True" if value == "1" else "False"
                        elif e.get("t") in (None, "n") and value is not None:
                            number = float(value)
                        if text:
                            yield place, name, row, column, text, number
                    elif kind == "row":
                        e.clear()


def cells(spark: SparkSession, path: str) -> DataFrame:
    """CELL of every workbook that the path names; one that cannot be read has no cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CELL.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        for batch in batches:
            for where, content in zip(*(c.to_pylist() for c in batch.columns)):
                held: list[tuple] = []
                try:
                    for cell in cells_in(content):
                        held.append((where, *cell))
                        if len(held) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                            held = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELL)


def stacked_table(cells: DataFrame, anchor: str, header: str, top: int = 12, above: int = 3, below: int = 2) -> DataFrame:
    """path, sheet, row, first, label, value of the table that each workbook holds, wherever it stands.

    The anchor is the first cell of the first ``top`` rows under a sheet's first whose text is ``anchor``, in any case; the value's column is the last one whose stacked header, from ``above``
    rows over the anchor's to ``below`` under it, holds ``header``. Rows below the anchor's give the texts of the first column (upper case) and of the
    anchor's, and the number of the value's; rows without label or number are left out. Of a workbook's sheets the first with such rows counts.
    """
    of = ["path", "place", "sheet"]
    named = (F.col("row") >= 1) & (F.col("row") <= top) & (F.lower(F.trim("text")) == anchor.lower())
    anchors = cells.where(named).groupBy(*of).agg(F.min(F.struct("row", "column")).alias("at")).select(*of, F.col("at.row").alias("a_row"), F.col("at.column").alias("a_column"))
    near = cells.join(anchors, of).where(F.col("row").between(F.greatest(F.lit(1), F.col("a_row") - above), F.col("a_row") + below))
    stacks = near.groupBy(*of, "column").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " ")).alias("stack"))  # a few rows each
    columns = stacks.where(F.col("stack").contains(header.lower())).groupBy(*of).agg(F.max("column").alias("v_column"))
    frame = anchors.join(columns, of)
    body = cells.join(frame, of).where((F.col("row") > F.col("a_row")) & F.col("column").isin(F.lit(0), F.col("a_column"), F.col("v_column")))
    text_of = lambda column: F.max(F.when(F.col("column") == column, F.trim("text")))
    number = F.coalesce(F.col("number"), F.trim("text").try_cast("double"))
    rows = body.groupBy(*of, "row").agg(F.upper(text_of(F.lit(0))).alias("first"), text_of(F.col("a_column")).alias("label"), F.max(F.when(F.col("column") == F.col("v_column"), number)).alias("value"))
    good = rows.where("label is not null and label <> '' and value is not null and not isnan(value)")
    least = F.min("place").over(Window.partitionBy("path"))
    return good.withColumn("least", least).where(F.col("place") == F.col("least")).select("path", "sheet", "row", "first", "label", "value")
