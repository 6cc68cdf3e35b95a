"""Workbooks as a Python data source: a partition for each file, so files are read where Spark puts their tasks.

`register(spark)` makes the format "outcome_sheets" known. The option `paths` names files, or folders of them, on a file
system that all executors share, separated by commas. Rows are (path, row, outcome, shortphrase): the first two columns of
a workbook's first sheet, without its header, of at most `rows` rows (SHEET_ROWS); rows without an outcome go. A
workbook is a zip file of small XML parts, so nothing but the sheet and its shared texts is read of it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a sheet that are read, the header among them.
SHEET_ROWS = 31
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


@dataclass
class Workbook(InputPartition):
    """One file."""

    path: str


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def first_columns(data: bytes, rows: int) -> Iterator[tuple[int, str | None, str | None]]:
    """(row from 1, A, B) of the first sheet's first rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = [_texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_MAIN}row"):
            number = int(row.get("r", 0))
            if number > rows:
                return
            cells: dict[str, str | None] = {}
            for cell in row.iter(f"{_MAIN}c"):
                column = re.match("[A-Z]+", cell.get("r", "")).group()
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "s" and value is not None:
                    cells[column] = shared[int(value.text)]
                elif cell.get("t") == "inlineStr":
                    cells[column] = _texts(cell)
                else:
                    cells[column] = None if value is None else value.text
            yield number, cells.get("A"), cells.get("B")


class SheetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.rows = options["paths"].split(","), int(options.get("rows", SHEET_ROWS))

    def partitions(self) -> list[Workbook]:
        """Names of files only: none is opened on the driver."""
        out = []
        for uri in self.paths:
            system, path = _place(uri.strip())
            info = system.get_file_info(path)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
            prefix = uri.strip()[: uri.strip().index(path)] if path in uri else ""
            out += [Workbook(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".xlsx")]
        return out

    def read(self, partition: Workbook) -> Iterator[tuple]:
        system, path = _place(partition.path)
        with system.open_input_stream(path) as f:
            data = f.read()
        for number, outcome, phrase in first_columns(data, self.rows):
            if number > 1 and (outcome or "").strip():
                yield partition.path, number, outcome, phrase


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outcome_sheets"

    def schema(self) -> str:
        return "path string, row int, outcome string, shortphrase string"

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)
