"""A3: a folder of ``.xlsx`` workbooks as one DataFrame, one task per workbook.

A Python data source (Spark's ``DataSource`` API): the planner lists the
files, every file becomes one input partition, and each task unpacks its
workbook with the standard library (an ``.xlsx`` is a zip of XML parts). The
first sheet (or ``sheet``) is read, the first row gives the column names, and
values arrive as text; :func:`read_excel` then types the columns whose every
value parses as a number. Legacy ``.xls`` files are refused.
"""

from __future__ import annotations

import glob as globmod
import posixpath
import re
import zipfile
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_path(z: zipfile.ZipFile, sheet) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = wb.findall("m:sheets/m:sheet", NS)
    if isinstance(sheet, int):
        node = sheets[sheet]
    else:
        node = next(s for s in sheets if s.get("name") == sheet)
    rid = node.get(f"{{{NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels.findall("rel:Relationship", NS) if r.get("Id") == rid)
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))


def read_rows(path: str, sheet=0) -> list[list[str | None]]:
    """All rows of one sheet as text (None for empty cells)."""
    if not path.lower().endswith(".xlsx"):
        raise ValueError(f"only .xlsx workbooks are supported: {path}")
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
        root = ET.fromstring(z.read(_sheet_path(z, sheet)))
    rows = []
    for row in root.findall("m:sheetData/m:row", NS):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", NS):
            kind = c.get("t")
            v = c.find("m:v", NS)
            if kind == "s":
                val = shared[int(v.text)] if v is not None else None
            elif kind == "inlineStr":
                val = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
            elif kind == "b":
                val = None if v is None else ("True" if v.text == "1" else "False")
            else:
                val = v.text if v is not None else None
            cells[_col_index(c.get("r"))] = val
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


class _Partition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ExcelReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType, sheet):
        self.paths, self.schema, self.sheet = paths, schema, sheet

    def partitions(self):
        return [_Partition(p) for p in self.paths]

    def read(self, partition):
        names = [f.name for f in self.schema.fields if f.name != "_source_file"]
        rows = read_rows(partition.path, self.sheet)
        if not rows:
            return
        header = [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(rows[0])]
        pos = {h: i for i, h in enumerate(header)}
        for r in rows[1:]:
            yield tuple([r[pos[n]] if n in pos and pos[n] < len(r) else None for n in names] + [partition.path])


class ExcelDataSource(DataSource):
    """``spark.read.format("xlsx").option("path", glob)``; options ``sheet``."""

    @classmethod
    def name(cls):
        return "xlsx"

    def _paths(self) -> list[str]:
        pattern = self.options.get("path")
        paths = sorted(globmod.glob(pattern)) if any(ch in pattern for ch in "*?[") else [pattern]
        if not paths:
            raise FileNotFoundError(pattern)
        return paths

    def _sheet(self):
        s = self.options.get("sheet", "0")
        return int(s) if str(s).isdigit() else s

    def schema(self):
        # header of the first workbook, plus the source file of every row
        rows = read_rows(self._paths()[0], self._sheet())
        header = rows[0] if rows else []
        fields = [StructField(h if h is not None else f"Unnamed: {i}", StringType(), True)
                  for i, h in enumerate(header)]
        return StructType(fields + [StructField("_source_file", StringType(), True)])

    def reader(self, schema: StructType):
        return ExcelReader(self._paths(), schema, self._sheet())


def infer_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Cast text columns whose every non-null value parses as a number (one aggregate)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)
                    and f.name != "_source_file"]
    if not cols:
        return df
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(f"p{i}") for i, c in enumerate(cols)]).first()
    todo = {}
    for i, c in enumerate(cols):
        if row[f"n{i}"] and row[f"n{i}"] == row[f"p{i}"]:
            todo[c] = F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return df.withColumns(todo) if todo else df


def read_excel(spark: SparkSession, path: str, sheet=0, infer_types: bool = True) -> DataFrame:
    """A3: every workbook matching ``path`` (a file or a glob), one task each."""
    spark.dataSource.register(ExcelDataSource)
    df = spark.read.format("xlsx").option("path", path).option("sheet", str(sheet)).load()
    return infer_numeric(df) if infer_types else df
