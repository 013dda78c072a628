"""A Python data source for workbooks: zip and XML only, all sheets, cells as strings by position.

Rows are (sheet, row_no, cells); ``cells`` has the values from column A on. Files are the partitions. Options:
``skip_sheets`` (names between commas). ``named`` turns rows below a heading into columns.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheets(path: str):
    """(sheet name, row number, cells) of a workbook."""
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        shared = [_texts(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[s.get(_REL)].lstrip("/")
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, row in ET.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    cells: list[str | None] = []
                    for c in row.iter(f"{_MAIN}c"):
                        at = _column(c.get("r", "")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        kind, v = c.get("t"), c.find(f"{_MAIN}v")
                        cells[at] = shared[int(v.text)] if kind == "s" and v is not None else _texts(c) if kind == "inlineStr" else v.text if v is not None else None
                    yield s.get("name"), int(row.get("r", 0)), cells
                    row.clear()


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = [options["path"]]
        self.skip = {s.strip() for s in options.get("skip_sheets", "").split(",") if s.strip()}

    def partitions(self):
        import glob

        return [InputPartition(p) for path in self.paths for p in sorted(glob.glob(path.removeprefix("file://"))) or [path]]

    def read(self, partition):
        for name, number, cells in sheets(partition.value):
            if name not in self.skip:
                yield name, number, cells


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "sheet string, row_no int, cells array<string>"

    def reader(self, schema):
        return _Reader(self.options)


def named(rows: DataFrame, columns: dict[str, int], heading_rows: int = 1) -> DataFrame:
    """(sheet, row_no, the columns by position) below the heading."""
    return rows.where(F.col("row_no") > heading_rows).select("sheet", "row_no", *[F.get("cells", F.lit(k)).alias(c) for c, k in columns.items()])
