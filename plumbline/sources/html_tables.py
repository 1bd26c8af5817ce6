"""First table of an HTML page, read as browsers read it: cells and rows end without end tags, spans fill a grid."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_COLUMNS, MOST_ROWS = 1000, 65_534  # of one cell, as the HTML standard clamps them
SECTIONS = {"thead", "tbody", "tfoot"}
UNSEEN = {"script", "style", "template"}


def _span(value: str | None, most: int) -> int:
    text = (value or "1").strip()
    return min(int(text), most) if text.isascii() and text.isdigit() else 1


class FirstTable(HTMLParser):
    """Cells (row, column, text) of the first table; a table inside a cell is text of that cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, str]] = []
        self.depth, self.done, self.unseen = 0, False, 0
        self.row, self.column = -1, 0
        self.in_row = False
        self.cell: tuple[int, int] | None = None  # columns and rows of the open cell
        self.parts: list[str] = []
        self.below: dict[int, tuple[int, str]] = {}  # column: rows that a cell above still fills, and its text

    def parse_marked_section(self, i, report=1):
        """Everything from ``<![`` or ``<!`` to the next ``>`` is a comment."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    parse_html_declaration = parse_declaration = parse_marked_section

    def _continue(self, column: int) -> None:
        """The cell above also fills this column of the row."""
        left, text = self.below.pop(column)
        self.cells.append((self.row, column, text))
        if left > 1:
            self.below[column] = (left - 1, text)

    def _fill_from_above(self) -> None:
        while self.column in self.below:
            self._continue(self.column)
            self.column += 1

    def _end_cell(self) -> None:
        if self.cell is None:
            return
        text, (columns, rows) = "".join(self.parts).strip(), self.cell
        self.cell, self.parts = None, []
        self._fill_from_above()
        for _ in range(columns):
            if self.column in self.below:  # cells that overlap: the one above stays
                self._continue(self.column)
                self.column += 1
                continue
            self.cells.append((self.row, self.column, text))
            if rows > 1:
                self.below[self.column] = (rows - 1, text)
            self.column += 1

    def _end_row(self) -> None:
        self._end_cell()
        if self.in_row:
            for column in [c for c in self.below if c >= self.column]:
                self._continue(column)
        self.in_row = False

    def _begin_row(self) -> None:
        self._end_row()
        self.row, self.column, self.in_row = self.row + 1, 0, True

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == "table":
            self.depth += 1
        if self.depth > 1:
            if tag in ("table", "tr", "td", "th", "caption"):
                self.parts.append(" ")
        elif self.depth == 1:
            if tag == "tr":
                self._begin_row()
            elif tag in SECTIONS:
                self._end_section()
            elif tag in ("td", "th"):
                self._end_cell()
                if not self.in_row:
                    self._begin_row()
                given = dict(attrs)
                self.cell = (max(1, _span(given.get("colspan"), MOST_COLUMNS)), _span(given.get("rowspan"), MOST_ROWS) or MOST_ROWS)
            elif tag == "br":
                self.parts.append(" ")

    def _end_section(self) -> None:
        self._end_row()
        self.below.clear()  # no cell reaches beyond its section

    def handle_endtag(self, tag):
        if self.done:
            return
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self._end_section()
                self.done = True
            else:
                self.parts.append(" ")
        elif self.depth == 1:
            if tag in ("td", "th"):
                self._end_cell()
            elif tag == "tr":
                self._end_row()
            elif tag in SECTIONS:
                self._end_section()

    def handle_data(self, data):
        if self.cell is not None and not self.unseen:
            self.parts.append(data)


def first_table(html: str) -> list[tuple[int, int, str]]:
    """Cells of the first table of a page, in order of row and column; a table without an end goes to the end of the page."""
    reader = FirstTable()
    reader.feed(html)
    if not reader.done:
        if reader.rawdata[:1] == "<":  # a tag or comment that the page's end cuts off
            reader.rawdata = ""
        reader.close()
        reader._end_section()
    return sorted(reader.cells, key=lambda c: c[:2])


def html_table_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """Cells of the first table of each page: ``(key, row_no, col_no, value)``; pages without one have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, page in enumerate(batch.column("html")):  # page by page: a page may hold a large table
                cells = first_table(page.as_py() or "")
                if cells:
                    rows, columns, texts = zip(*cells)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array([k] * len(cells))), pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(texts, pa.string())],
                        names=["key", "row_no", "col_no", "value"])

    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{html}`").cast("string").alias("html")).filter(F.lower("html").contains("<table"))
    schema = T.StructType([
        T.StructField("key", source.schema["key"].dataType), T.StructField("row_no", T.IntegerType()), T.StructField("col_no", T.IntegerType()), T.StructField("value", T.StringType())])
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
