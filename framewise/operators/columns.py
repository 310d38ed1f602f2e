"""Projection-level operators: select, one-hot, preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import q


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1: keep the chosen columns in the given order; an empty choice is refused."""
    cols = list(cols)
    if not cols:
        raise ValueError("select at least one column")
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return df.select(*[q(c) for c in cols])


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    """B2: rows whose ``col`` equals ``value`` (null never matches)."""
    return df.where(q(col) == F.lit(value))


def category_values(df: DataFrame, col: str, max_categories: int | None = None) -> list:
    """Sorted distinct non-null values: each becomes a column, so they are as
    many as a table can have columns. ``max_categories`` refuses more than that."""
    distinct = df.select(q(col).alias("v")).where(F.col("v").isNotNull()).distinct()
    vals = (distinct.limit(max_categories + 1) if max_categories else distinct).collect()
    if max_categories and len(vals) > max_categories:
        raise ValueError(f"{col!r} has more than {max_categories} categories")
    return sorted(r["v"] for r in vals)


def _label(v) -> str:
    return str(v)


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True,
            max_categories: int | None = None) -> DataFrame:
    """``{col}_{value}`` boolean columns, categories sorted, first dropped.

    New columns are appended after the remaining ones and the source columns
    are removed; a null source value gives all-false indicators."""
    cols = list(cols)
    new = []
    for c in cols:
        cats = category_values(df, c, max_categories)
        if drop_first:
            cats = cats[1:]
        for v in cats:
            new.append(F.coalesce(q(c) == F.lit(v), F.lit(False)).alias(f"{c}_{_label(v)}"))
    keep = [q(c) for c in df.columns if c not in cols]
    return df.select(*keep, *new)


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows by an explicit order (top-k, no global sort)."""
    if order_by:
        df = df.orderBy(*[q(c) for c in order_by])
    return df.limit(n)
