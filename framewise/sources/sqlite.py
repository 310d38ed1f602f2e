"""A4, A5: tables of a SQLite file, read in parallel rowid ranges.

No SQLite JDBC driver ships with Spark, so this is a Python data source over
the standard ``sqlite3`` module. The planner splits ``[min(rowid),
max(rowid)]`` into ``partitions`` ranges; each task opens the file read-only
and reads its range. The file must be reachable from every executor (a shared
mount); the table name is always quoted.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (BinaryType, DoubleType, LongType, StringType, StructField, StructType)


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _spark_type(decl: str):
    d = (decl or "").upper()
    if "INT" in d:
        return LongType()
    if any(k in d for k in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return DoubleType()
    if "BLOB" in d:
        return BinaryType()
    return StringType()


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class SQLiteReader(DataSourceReader):
    def __init__(self, path: str, table: str, n: int, schema: StructType):
        self.path, self.table, self.n, self.schema = path, table, n, schema

    def partitions(self):
        with _connect(self.path) as con:
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(self.table)}").fetchone()
        if lo is None:
            return [_Range(0, -1)]
        step = max(1, -(-(hi - lo + 1) // self.n))
        return [_Range(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition):
        cols = ", ".join(_quote(f.name) for f in self.schema.fields)
        sql = f"SELECT {cols} FROM {_quote(self.table)} WHERE rowid BETWEEN ? AND ?"
        casts = [f.dataType for f in self.schema.fields]
        with _connect(self.path) as con:
            for row in con.execute(sql, (partition.lo, partition.hi)):
                out = []
                for v, t in zip(row, casts):
                    if v is None:
                        out.append(None)
                    elif isinstance(t, LongType):
                        out.append(int(v) if isinstance(v, (int, float)) else _try(int, v))
                    elif isinstance(t, DoubleType):
                        out.append(float(v) if isinstance(v, (int, float)) else _try(float, v))
                    elif isinstance(t, BinaryType):
                        out.append(bytes(v))
                    else:
                        out.append(str(v))
                yield tuple(out)


def _try(fn, v):
    try:
        return fn(v)
    except (TypeError, ValueError):
        return None


class SQLiteDataSource(DataSource):
    """``spark.read.format("sqlite").option("path", file).option("table", t)``."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        path, table = self.options["path"], self.options["table"]
        with _connect(path) as con:
            info = con.execute(f"PRAGMA table_info({_quote(table)})").fetchall()
        if not info:
            raise ValueError(f"no table {table!r} in {path}")
        return StructType([StructField(r[1], _spark_type(r[2]), True) for r in info])

    def reader(self, schema: StructType):
        return SQLiteReader(self.options["path"], self.options["table"],
                            int(self.options.get("partitions", "4")), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    """A4: ``SELECT *`` of one table, ``partitions`` parallel rowid ranges."""
    spark.dataSource.register(SQLiteDataSource)
    return (spark.read.format("sqlite").option("path", path).option("table", table)
            .option("partitions", str(partitions)).load())


def list_tables(spark: SparkSession, path: str) -> DataFrame:
    """A5: names of the tables (not views) in a SQLite file."""
    with _connect(path) as con:
        names = [r[0] for r in con.execute(
            "SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall()]
    return spark.createDataFrame([(n,) for n in names], "table_name string")
