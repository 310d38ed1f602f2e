"""Profiling: overview, column information, insights, describe, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import (as_double, clean_value, is_missing, missing_cells,
                                         numeric_columns, q, string_columns)
from framewise.functions.quantiles import quantile_table
from framewise.operators.clean import mode_table


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows in one shuffle.

    Rows are grouped on all columns (map-side combined, so a heavily duplicated
    row collapses before the exchange); the groups give the row count, the
    distinct count and the missing cells at once."""
    cols = [q(c) for c in df.columns]
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    miss = missing_cells(df)
    return g.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.coalesce(F.sum(miss * F.col("_c")), F.lit(0)).cast("long").alias("missing_cells"),
        (F.coalesce(F.sum("_c"), F.lit(0)) - F.count(F.lit(1))).cast("long").alias("duplicate_rows"),
    )


def column_info(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, non-null, null and unique counts.

    One aggregate computes every count; ``approx=True`` uses HyperLogLog for the
    unique count instead of an exact distinct (which expands rows per column)."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = clean_value(df, c)
        aggs += [F.sum(F.when(~is_missing(df, c), 1).otherwise(0)).cast("long").alias(f"nn{i}"),
                 (F.approx_count_distinct(v) if approx else F.count_distinct(v)).cast("long").alias(f"u{i}")]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    pairs = F.array(*[F.struct(F.lit(i).cast("int").alias("position"), F.lit(c).alias("column"),
                               F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                               F.col(f"nn{i}").alias("non_null"),
                               (F.col("_rows") - F.col(f"nn{i}")).alias("null_count"),
                               F.col(f"u{i}").alias("unique"))
                      for i, c in enumerate(df.columns)])
    return row.select(F.inline(pairs))


def numeric_insights(df: DataFrame, n: int = 3, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean, median, sample std of the first ``n`` numeric columns."""
    cols = list(cols) if cols is not None else numeric_columns(df)[:n]
    return describe(df, cols, probs=(0.5,)).select("position", "column", "mean", F.col("50%").alias("median"), "std")


def categorical_insights(df: DataFrame, n: int = 3, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value (ties -> smallest) and its count, first ``n`` text columns."""
    cols = list(cols) if cols is not None else string_columns(df)[:n]
    parts = [mode_table(df, c).select(F.lit(i).cast("int").alias("position"), F.lit(c).alias("column"),
                                      F.col("mode").cast("string").alias("top_value"), "count")
             for i, c in enumerate(cols)]
    if not parts:
        return df.sparkSession.createDataFrame([], "position int, column string, top_value string, count long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("position", "column", F.coalesce("top_value", F.lit("N/A")).alias("top_value"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
             probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """P5: count, mean, std, min, quartiles (interpolated), max per column.

    One aggregate for the moments, one distributed quantile pass; the result
    has one row per column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "position int, column string, count long, mean double, "
                                               "std double, min double, `25%` double, `50%` double, "
                                               "`75%` double, max double")
    aggs = []
    for i, c in enumerate(cols):
        x = as_double(df, c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    mom = df.agg(*aggs)
    mom = mom.select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("int").alias("position"), F.lit(c).alias("column"),
                 F.col(f"n{i}").cast("long").alias("count"), F.col(f"m{i}").alias("mean"),
                 F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)])))
    # only the wanted quartiles are selected; the others are null columns
    qt = quantile_table(df, cols, list(probs), approx=approx)
    qw = qt.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
                                    for p, name in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%"))])
    out = mom.join(qw, "column", "left")
    return out.select("position", "column", *STATS)


def summary_report(df: DataFrame, approx: bool = False) -> DataFrame:
    """:func:`describe` over every numeric column."""
    return describe(df, numeric_columns(df), approx)


def dataset_summary(df: DataFrame, order_by: Sequence[str] | None = None, n_rows: int = 3) -> DataFrame:
    """One row: shape, column names, missing cells, types and the first rows as JSON."""
    head = df.orderBy(*[q(c) for c in order_by]) if order_by else df
    # at most n_rows rows reach the driver
    first = "[" + ",".join(head.limit(n_rows).toJSON().collect()) + "]"
    names = ", ".join(df.columns)
    types = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields)
    return overview(df).select("rows", "columns", F.lit(names).alias("column_names"), "missing_cells",
                               F.lit(types).alias("dtypes"), F.lit(first).alias("first_rows"))
