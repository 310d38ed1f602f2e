"""Cleaning operators (missing values, duplicates, outliers) and the recipe.

Statistics (means, medians, modes, fences) are computed by one distributed
aggregate per step and come back as a handful of literals; the rows themselves
never leave the executors, and the returned DataFrame is a lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.columns import (as_double, clean_value, missing_cells, numeric_columns,
                                         q)
from framewise.functions.quantiles import quantile_table
from framewise.session import cut_lineage


# --------------------------------------------------------------------- missing
def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (NULL or NaN) in ``subset``."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    out = {}
    for c, v in values.items():
        if v is None:
            continue
        # the fill value takes the column's type (a Python datetime literal would
        # otherwise turn a timestamp_ntz column into a local timestamp)
        out[c] = F.coalesce(clean_value(df, c), F.lit(v).cast(df.schema[c].dataType))
    return df.withColumns(out) if out else df


def _null_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.count(F.lit(1)).alias("_n")] +
                 [F.count(clean_value(df, c)).alias(c) for c in cols]).first()
    return {c: row["_n"] - row[c] for c in cols}


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    row = df.agg(*[F.avg(as_double(df, c)).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def _fill_numeric(df: DataFrame, stats: dict[str, float | None], nulls: dict[str, int]) -> DataFrame:
    # only columns that have something to fill change (and become double),
    # as a pandas integer column without NaN keeps its type
    todo = {c: v for c, v in stats.items() if v is not None and nulls.get(c, 0) > 0}
    df = df.withColumns({c: as_double(df, c) for c in todo})
    return _fill(df, todo)


def fill_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill numeric columns with their mean; filled columns become double."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df
    row = df.agg(*[F.count(F.lit(1)).alias("_n")] +
                 [F.count(clean_value(df, c)).alias(f"n_{c}") for c in cols] +
                 [F.avg(as_double(df, c)).alias(f"m_{c}") for c in cols]).first()
    nulls = {c: row["_n"] - row[f"n_{c}"] for c in cols}
    return _fill_numeric(df, {c: row[f"m_{c}"] for c in cols}, nulls)


def column_medians(df: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, float | None]:
    if not cols:
        return {}
    rows = quantile_table(df, cols, [0.5], approx=approx).collect()
    return {r["column"]: r["value"] for r in rows}


def fill_median(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Fill numeric columns with their exact (interpolated) median."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df
    nulls = _null_counts(df, cols)
    todo = [c for c in cols if nulls[c] > 0]
    return _fill_numeric(df, column_medians(df, todo, approx), nulls)


def mode_table(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null value (ties -> smallest) and its count, per group.

    A partial + final count per (group, value), then a min over
    ``(-count, value)`` per group: nothing holds a whole group in memory.
    """
    by = list(by)
    v = clean_value(df, name).alias("_v")
    counts = (df.select(*[q(b) for b in by], v).where(F.col("_v").isNotNull())
              .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_v").alias("v")))
                                   .alias("_b"))
    return best.select(*by, F.col("_b.v").alias("mode"), (-F.col("_b.neg")).alias("count"))


def mode_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the mode of each column as ``m0``, ``m1``, .., in the column's own type, all in one action: every column
    gives a row that is null but for its own mode, and the first value of each column is kept."""
    kinds = [df.schema[c].dataType for c in cols]
    parts = [mode_table(df, c).select(*[(F.col("mode") if j == i else F.lit(None)).cast(t).alias(f"m{j}") for j, t in enumerate(kinds)])
             for i, c in enumerate(cols)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(*[F.any_value(f"m{j}", ignoreNulls=True).alias(f"m{j}") for j in range(len(cols))])


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Mode of each column (one value per column on the driver); null for a column without values."""
    cols = list(cols)
    return dict(zip(cols, mode_row(df, cols).first())) if cols else {}


def fill_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C4: fill every column with its mode (ties -> smallest value). Only columns that miss something are counted; the fill
    values stay on the executors, in the columns' own types. Map columns have no mode and stay as they are."""
    cols = [c for c in (cols if cols is not None else df.columns) if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    nulls = _null_counts(df, cols) if cols else {}
    todo = [c for c in cols if nulls[c]]
    if not todo:
        return df
    modes = cut_lineage(mode_row(df, todo))
    return df.withColumns({c: F.coalesce(clean_value(df, c), modes.select(f"m{i}").scalar()) for i, c in enumerate(todo)})


# ------------------------------------------------------------------ duplicates
def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Remove duplicate rows (whole row; nulls compare equal)."""
    return df.dropDuplicates(list(subset)) if subset else df.distinct()


# -------------------------------------------------------------------- outliers
def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5,
               approx: bool = False) -> dict[str, tuple[float, float] | None]:
    """Fences ``Q1 - k*IQR``, ``Q3 + k*IQR`` with linear-interpolated quartiles."""
    rows = quantile_table(df, cols, [0.25, 0.75], approx=approx).collect()
    qs = {(r["column"], r["prob"]): r["value"] for r in rows}
    out = {}
    for c in cols:
        q1, q3 = qs.get((c, 0.25)), qs.get((c, 0.75))
        if q1 is None or q3 is None:
            out[c] = None
        else:
            iqr = q3 - q1
            out[c] = (q1 - k * iqr, q3 + k * iqr)
    return out


def zscore_bounds(df: DataFrame, cols: Sequence[str], z: float = 3.0) -> dict[str, tuple[float, float, float, float] | None]:
    """(mean, std, lower, upper) with sample std; None when std is 0 or undefined."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        x = as_double(df, c)
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = None if m is None or s is None or s == 0 or s != s else (m, s, m - z * s, m + z * s)
    return out


def _outside(df: DataFrame, c: str, lo: float, hi: float) -> Column:
    x = as_double(df, c)
    return (x < F.lit(lo)) | (x > F.lit(hi))


def iqr_remove(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
               sequential: bool = True, approx: bool = False) -> DataFrame:
    """Drop rows outside the IQR fences (strict); rows with null kept.

    ``sequential=True`` matches the reference: a column's fences are computed
    after the earlier columns removed their rows (one job per column).
    ``sequential=False`` computes all fences in one pass.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not sequential:
        fences = iqr_fences(df, cols, k, approx)
        for c in cols:
            if fences[c]:
                df = df.where(~F.coalesce(_outside(df, c, *fences[c]), F.lit(False)))
        return df
    for c in cols:
        f = iqr_fences(df, [c], k, approx)[c]
        if f:
            df = df.where(~F.coalesce(_outside(df, c, *f), F.lit(False)))
    return df


def _cap(df: DataFrame, c: str, lo: float, hi: float) -> Column:
    x = as_double(df, c)
    return F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def iqr_cap(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
            approx: bool = False) -> DataFrame:
    """Clip values to the IQR fences; capped columns become double.

    Capping one column never changes another column's values, so all fences
    come from one aggregate pass."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    fences = iqr_fences(df, cols, k, approx)
    return df.withColumns({c: _cap(df, c, *fences[c]) for c in cols if fences[c]})


def zscore_remove(df: DataFrame, cols: Sequence[str] | None = None, z: float = 3.0,
                  sequential: bool = True) -> DataFrame:
    """Drop rows with ``|x - mean| / std > z`` (sample std); nulls kept."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not sequential:
        bounds = zscore_bounds(df, cols, z)
        for c in cols:
            if bounds[c]:
                df = df.where(~F.coalesce(_outside(df, c, bounds[c][2], bounds[c][3]), F.lit(False)))
        return df
    for c in cols:
        b = zscore_bounds(df, [c], z)[c]
        if b:
            m, s = b[0], b[1]
            zc = F.abs((as_double(df, c) - F.lit(m)) / F.lit(s))
            df = df.where(~F.coalesce(zc > F.lit(z), F.lit(False)))
    return df


def zscore_cap(df: DataFrame, cols: Sequence[str] | None = None, z: float = 3.0) -> DataFrame:
    """C11: clip values to mean +- z * std (the reference never defines these bounds)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    bounds = zscore_bounds(df, cols, z)
    return df.withColumns({c: _cap(df, c, bounds[c][2], bounds[c][3]) for c in cols if bounds[c]})


# ---------------------------------------------------------------------- recipe
@dataclass
class CleanSpec:
    """What the cleaning step does, in the fixed order
    missing -> duplicates -> outliers -> one-hot -> datetime parts."""
    missing: str | None = None          # drop | mean | median | mode | ffill | bfill
    order_by: Sequence[str] = ()        # needed by ffill / bfill
    drop_duplicates: bool = False
    outliers: str | None = None         # iqr | zscore
    outlier_action: str = "remove"      # remove | cap
    outlier_cols: Sequence[str] | None = None
    one_hot: Sequence[str] = field(default_factory=list)
    datetime_col: str | None = None
    datetime_parts: Sequence[str] = ()


def clean(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """Apply a :class:`CleanSpec`."""
    from framewise.functions.scalar import datetime_features_checked
    from framewise.operators.columns import one_hot
    from framewise.plans.ordered import bfill, ffill

    if spec.missing == "drop":
        df = drop_missing(df)
    elif spec.missing == "mean":
        df = fill_mean(df)
    elif spec.missing == "median":
        df = fill_median(df)
    elif spec.missing == "mode":
        df = fill_mode(df)
    elif spec.missing == "ffill":
        df = ffill(df, spec.order_by)
    elif spec.missing == "bfill":
        df = bfill(df, spec.order_by)
    elif spec.missing is not None:
        raise ValueError(f"unknown missing action {spec.missing!r}")
    if spec.drop_duplicates:
        df = drop_duplicates(df)
        if spec.outliers:
            df = cut_lineage(df)  # each column's fences read the rows: the shuffle of the duplicates is done once
    if spec.outliers:
        cols = spec.outlier_cols
        if spec.outliers == "iqr":
            df = iqr_remove(df, cols) if spec.outlier_action == "remove" else iqr_cap(df, cols)
        elif spec.outliers == "zscore":
            df = zscore_remove(df, cols) if spec.outlier_action == "remove" else zscore_cap(df, cols)
        else:
            raise ValueError(f"unknown outlier method {spec.outliers!r}")
    if spec.one_hot:
        df = one_hot(df, spec.one_hot)
    if spec.datetime_col and spec.datetime_parts and spec.datetime_col in df.columns:
        df = datetime_features_checked(df, spec.datetime_col, spec.datetime_parts)
    return df


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and missing cells before and after, as two rows."""
    def one(df: DataFrame, stage: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows"),
                      F.coalesce(F.sum(missing_cells(df)), F.lit(0)).cast("long").alias("missing_cells")
                      ).select(F.lit(stage).alias("stage"), "rows",
                               F.lit(len(df.columns)).cast("long").alias("columns"), "missing_cells")
    return one(before, "original").unionByName(one(after, "cleaned"))

