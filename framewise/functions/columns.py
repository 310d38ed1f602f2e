"""Column classification and null helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.session import cut_lineage

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def q(name: str) -> Column:
    """Column by exact name (dots and spaces taken literally)."""
    return F.col("`" + name.replace("`", "``") + "`")


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame) -> list[str]:
    """Measure columns: numbers, not booleans (like ``select_dtypes(np.number)``)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME)]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, and NaN for floating columns: both are "missing" as in pandas."""
    c = q(name)
    if isinstance(field_type(df, name), FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def clean_value(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL (so aggregates skip it like pandas)."""
    c = q(name)
    if isinstance(field_type(df, name), FLOATING):
        return F.when(~F.isnan(c), c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    return clean_value(df, name).cast("double")


def missing_cells(df: DataFrame) -> Column:
    """Number of missing cells in one row."""
    if not df.columns:
        return F.lit(0).cast("long")
    return sum((is_missing(df, c).cast("long") for c in df.columns), F.lit(0).cast("long"))


class TableSize(NamedTuple):
    rows: int
    bytes: int


def table_size(table: DataFrame) -> TableSize:
    """Rows and bytes of a (checkpointed) table: texts and binaries by their length, other columns as 16 bytes."""
    width = F.lit(16 * len(table.columns))
    for f in table.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(q(f.name)), F.lit(0))
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return TableSize(rows, size)


BROADCAST_BYTES = 8 << 20


def join_sized(big: DataFrame, small: DataFrame, keys: Sequence[str], size: TableSize, how: str = "inner") -> DataFrame:
    """``big.join(small)``: broadcast if the measured size is at most ``BROADCAST_BYTES``, else shuffled, where Spark splits
    hot keys."""
    return big.join(F.broadcast(small) if size.bytes <= BROADCAST_BYTES else small, list(keys), how)


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group statistics table onto the rows: checkpointed, its bytes measured, broadcast if they are few."""
    small = cut_lineage(small)
    return join_sized(big, small, keys, table_size(small), how)
