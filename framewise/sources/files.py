"""Delimited text and JSON files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, header: bool = True, infer_schema: bool = True,
             **options) -> DataFrame:
    """A1: first row is the header; empty fields are null; types inferred
    (pass ``schema=`` in production to skip the inference pass)."""
    reader = spark.read.option("header", header).option("inferSchema", infer_schema)
    schema = options.pop("schema", None)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).csv(path)


def read_json(spark: SparkSession, path: str, multi_line: bool = True, **options) -> DataFrame:
    """A2: a file holding a top-level array of objects (``multiLine``); set
    ``multi_line=False`` for one object per line, which splits across tasks."""
    schema = options.pop("schema", None)
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).json(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Header row, no index column; one part file per task unless
    ``single_file`` (which funnels the data through one task - small results only)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)
