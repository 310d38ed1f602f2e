"""Nested records to flat columns (``a.b``); arrays stay one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat_fields(dt: T.StructType, prefix: list[str]) -> list[tuple[list[str], T.DataType]]:
    out = []
    for f in dt.fields:
        path = prefix + [f.name]
        if isinstance(f.dataType, T.StructType):
            out += _flat_fields(f.dataType, path)
        else:
            out.append((path, f.dataType))
    return out


def _get(path: list[str]) -> Column:
    c = F.col("`" + path[0].replace("`", "``") + "`")
    for p in path[1:]:
        c = c.getField(p)
    return c


def flatten_json(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct fields become ``parent.child`` columns, recursively."""
    cols = [_get(path).alias(sep.join(path)) for path, _ in _flat_fields(df.schema, [])]
    return df.select(*cols)


def infer_json_schema(df: DataFrame, col: str) -> T.DataType:
    """Schema of a JSON text column over all rows: each text becomes a variant, whose schemas are merged by a partial and a
    final aggregate. Texts that are not JSON count for nothing; fields of different types in different rows become what can
    hold both (numbers of either kind: double; else text)."""
    variant = F.try_parse_json(F.col(col).cast("string"))
    found = df.agg(F.schema_of_variant_agg(variant)).first()[0]
    return _storable(T._parse_datatype_string(found.replace("OBJECT<", "STRUCT<"))) if found else T.StringType()


def _storable(dt: T.DataType) -> T.DataType:
    """A variant's schema in types that JSON is read into: whole numbers as long, other numbers as double."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _storable(f.dataType)) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_storable(dt.elementType))
    if isinstance(dt, T.DecimalType):
        return T.DoubleType() if dt.scale else T.LongType()
    return T.StringType() if isinstance(dt, (T.NullType, T.VariantType)) else dt


def flatten_json_col(df: DataFrame, col: str, schema: T.StructType | str | None = None,
                     sep: str = ".") -> DataFrame:
    """Parse a JSON text column and flatten it into ``col.key`` columns next to
    the other columns (the text column itself is replaced)."""
    schema = schema or infer_json_schema(df, col)
    if isinstance(schema, (T.AtomicType, T.ArrayType)):
        return df if not isinstance(schema, T.ArrayType) else df.withColumn(col, F.from_json(F.col(col), schema))
    parsed = df.withColumn(col, F.from_json(F.col(col), schema))
    return flatten_json(parsed, sep)
