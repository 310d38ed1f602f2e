"""Aggregates behind KPI cards and charts (the rows a chart needs, built on Spark)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import as_double, join_small, numeric_columns, q
from framewise.functions.quantiles import quantile_table
from framewise.functions.sampling import sample
from framewise.functions.scalar import format_kpi
from framewise.session import cut_lineage

AGG_LABEL = {"Sum": "Total", "Average": "Avg", "Maximum": "Max"}


def kpi(df: DataFrame, cols: Sequence[str], agg: str = "Sum", compare: DataFrame | None = None) -> DataFrame:
    """G1: "Total Rows" card first, then ``Total/Avg/Max {col}`` cards.

    One global aggregate; columns: position, label, value, display. With
    ``compare`` (e.g. the previous period) each card also gets ``delta`` =
    value minus the same card computed on ``compare``."""
    if agg not in AGG_LABEL:
        raise ValueError(f"agg must be one of {list(AGG_LABEL)}")
    cards = _kpi_cards(df, cols, agg)
    if compare is None:
        return cards
    # the comparison cards are at most len(cols) + 1 rows: literals
    prev = {r["position"]: r["value"] for r in _kpi_cards(compare, cols, agg).collect()}
    delta = F.col("value") - F.element_at(F.create_map(*[x for pos, v in prev.items()
                                                         for x in (F.lit(pos), F.lit(v).cast("double"))]),
                                          F.col("position"))
    return cards.withColumn("delta", delta)


def _kpi_cards(df: DataFrame, cols: Sequence[str], agg: str) -> DataFrame:
    fn = {"Sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "Average": F.avg, "Maximum": F.max}[agg]
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[fn(as_double(df, c)).alias(f"_v{i}") for i, c in enumerate(cols)])
    cards = [F.struct(F.lit(0).alias("position"), F.lit("Total Rows").alias("label"),
                      F.col("_rows").cast("double").alias("value"),
                      F.format_number(F.col("_rows"), 0).alias("display"))]
    for i, c in enumerate(cols):
        v = F.col(f"_v{i}").cast("double")
        cards.append(F.struct(F.lit(i + 1).alias("position"), F.lit(f"{AGG_LABEL[agg]} {c}").alias("label"),
                              v.alias("value"), format_kpi(v).alias("display")))
    return row.select(F.inline(F.array(*cards)))


def kpi_summary(df: DataFrame, col: str | None = None) -> DataFrame:
    """Average, maximum, minimum of a column (first numeric column by default)."""
    col = col or numeric_columns(df)[0]
    x = as_double(df, col)
    return df.agg(F.lit(col).alias("column"), F.avg(x).alias("average"), F.max(x).alias("maximum"),
                  F.min(x).alias("minimum"))


def kpi_trend(df: DataFrame, col: str, order_by: Sequence[str], max_points: int | None = None) -> DataFrame:
    """G2 trend: the series in row order, every row a point; with ``max_points``,
    averaged into at most that many consecutive blocks. Row positions come
    from the bucketed ordering, not a one-task window."""
    from framewise.plans.ordered import row_index
    n = df.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "point long, first_row long, rows long, value double")
    idx = row_index(df.select(*[q(c) for c in order_by], as_double(df, col).alias("_v")), order_by, out="_i")
    pt = F.floor(F.col("_i") * F.lit(min(max_points or n, n)) / F.lit(n)).cast("long")
    return (idx.groupBy(pt.alias("point")).agg(F.min("_i").alias("first_row"), F.count(F.lit(1)).alias("rows"),
                                               F.avg("_v").alias("value")).orderBy("point"))


def bar_count(df: DataFrame, x: str) -> DataFrame:
    """Rows per category (null category dropped), sorted by category."""
    return (df.where(q(x).isNotNull()).groupBy(q(x).alias(x)).agg(F.count(F.lit(1)).alias("Count"))
            .orderBy(x))


def _median_by(df: DataFrame, by: str, col: str, name: str) -> DataFrame:
    groups = df.where(q(by).isNotNull()).groupBy(q(by).alias(by)).agg(F.count(F.lit(1)).alias("_rows"))
    med = quantile_table(df.where(q(by).isNotNull()), [col], [0.5], by=[by]).select(by, F.col("value").alias(name))
    return groups.join(med, by, "left").select(by, name)


def bar_agg(df: DataFrame, x: str, y: str, agg: str = "Sum") -> DataFrame:
    """``{y} Sum`` / ``{y} Mean`` / ``{y} Median`` per category of ``x``."""
    name = f"{y} {agg}"
    if agg == "Median":
        return _median_by(df, x, y, name).orderBy(x)
    fn = {"Sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)), "Mean": F.avg}[agg]
    return (df.where(q(x).isNotNull()).groupBy(q(x).alias(x)).agg(fn(as_double(df, y)).alias(name))
            .orderBy(x))


def grouped_stats(df: DataFrame, by: str, col: str, method: str = "mean") -> DataFrame:
    """``groupby(by)[col].agg(method)`` for mean, median, sum, count, std.

    Partial + final hash aggregate; median goes through the distributed
    quantile selection. Output columns: ``by``, ``col``."""
    x = as_double(df, col)
    if method == "median":
        return _median_by(df, by, col, col).orderBy(by)
    fns = {"mean": F.avg(x), "sum": F.coalesce(F.sum(x), F.lit(0.0)),
           "count": F.count(x), "std": F.stddev_samp(x)}
    if method not in fns:
        raise ValueError(f"unknown method {method!r}")
    return (df.where(q(by).isNotNull()).groupBy(q(by).alias(by)).agg(fns[method].alias(col))
            .orderBy(by))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed, empty bins kept.

    Columns: bin, lower, upper, count. A constant column gives one bin."""
    x = as_double(df, col)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    if hi == lo:
        bins = 1
    width = (hi - lo) / bins if hi > lo else 0.0
    if hi > lo:
        b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1))
    else:
        b = F.lit(0)
    counts = (df.select(b.cast("int").alias("bin")).where(F.col("bin").isNotNull())
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    F.when(F.col("bin") == bins - 1, F.lit(hi))
                    .otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count"))
            .orderBy("bin"))


def resample_mean(df: DataFrame, time: str, value: str, every: str = "day") -> DataFrame:
    """Mean of ``value`` per calendar ``every`` (day, hour, week, month...);
    empty periods and null times dropped."""
    t = F.date_trunc(every, q(time).cast("timestamp_ntz")).cast("timestamp_ntz")
    return (df.where(q(time).isNotNull()).groupBy(t.alias(time))
            .agg(F.avg(as_double(df, value)).alias(value))
            .where(F.col(value).isNotNull()).orderBy(time))


def box_stats(df: DataFrame, y: str, x: str | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, fences, whiskers (furthest values inside the fences) and
    outlier counts, per category of ``x`` (or overall)."""
    data = df.where(q(x).isNotNull()) if x else df
    by = [x] if x else []
    qt = quantile_table(data, [y], [0.25, 0.5, 0.75], by=by)
    qs = qt.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                               for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    qs = (qs.withColumn("lower_fence", F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1")))
          .withColumn("upper_fence", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))))
    v = as_double(df, y).alias("_y")
    pts = data.select(*[q(b).alias(b) for b in by], v).where(F.col("_y").isNotNull())
    # per-group fences: broadcast once their row count is proven small;
    # overall, the single row travels as literals
    joined = join_small(pts, qs, by) if by else _attach_row(pts, qs.first())
    inside = (F.col("_y") >= F.col("lower_fence")) & (F.col("_y") <= F.col("upper_fence"))
    agg = joined.groupBy(*by, "q1", "median", "q3", "lower_fence", "upper_fence").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.when(inside, F.col("_y"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_y"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"))
    cols = by + ["count", "q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low",
                 "whisker_high", "n_outliers"]
    out = agg.select(*cols)
    return out.orderBy(*by) if by else out


def _attach_row(df: DataFrame, row, extra=None) -> DataFrame:
    """Add the fields of one driver-side row (a bounded, single-row statistic)
    as literal columns."""
    fields = {}
    for r in (row, extra):
        if r is not None:
            fields.update(r.asDict())
    if row is None and extra is None:
        return df.where(F.lit(False))
    return df.withColumns({k: F.lit(v) for k, v in fields.items()})


def violin_density(df: DataFrame, y: str, x: str | None = None, points: int = 64,
                   fine_bins: int = 512) -> DataFrame:
    """Gaussian kernel density on a grid of ``points`` per group.

    Rows are scanned once into a fine histogram per group (bounded by
    ``fine_bins``); the kernel sum runs over bins x grid, never over row pairs.
    Bandwidth: Silverman's rule ``0.9 * min(std, IQR/1.34) * n^(-1/5)``."""
    data = df.where(q(x).isNotNull()) if x else df
    by = [x] if x else []
    v = as_double(df, y)
    pts = data.select(*[q(b).alias(b) for b in by], v.alias("_y")).where(F.col("_y").isNotNull())
    mom = pts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_y").alias("_sd"),
                               F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    qt = quantile_table(data, [y], [0.25, 0.75], by=by)
    iqr = qt.groupBy(*by).agg((F.max(F.when(F.col("prob") == 0.75, F.col("value")))
                               - F.max(F.when(F.col("prob") == 0.25, F.col("value")))).alias("_iqr"))
    par = mom.join(iqr, by, "left")if by else _attach_row(mom, None, iqr.first())
    spread = (F.when((F.col("_iqr") > 0) & (F.col("_iqr") / 1.34 < F.col("_sd")), F.col("_iqr") / 1.34)
              .otherwise(F.col("_sd")))
    par = par.withColumn("_h", F.lit(0.9) * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    par = par.withColumn("_h", F.when(F.col("_h") > 0, F.col("_h")).otherwise(F.lit(1.0)))
    width = F.col("_hi") - F.col("_lo")
    if not by:
        par_row = par.first()
        pts = _attach_row(pts, par_row)
    else:
        pts = join_small(pts, par, by)
    fine = (pts.withColumn("_b", F.when(width > 0, F.least(F.floor((F.col("_y") - F.col("_lo")) / width
                                                                    * F.lit(float(fine_bins))),
                                                           F.lit(fine_bins - 1))).otherwise(F.lit(0)))
            .groupBy(*by, "_b", "_n", "_lo", "_hi", "_h").agg(F.count(F.lit(1)).alias("_c"),
                                                              F.avg("_y").alias("_m")))
    grid_pos = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_g")
    lo_g = F.col("_lo") - 3 * F.col("_h")
    step = (width + 6 * F.col("_h")) / F.lit(float(points - 1))
    expanded = fine.select("*", grid_pos).withColumn("_gy", lo_g + F.col("_g") * step)
    z = (F.col("_gy") - F.col("_m")) / F.col("_h")
    kern = F.col("_c") * F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    out = expanded.groupBy(*by, "_g", "_gy").agg(F.sum(kern).alias("density"))
    return out.select(*by, F.col("_g").alias("point"), F.col("_gy").alias("y"), "density").orderBy(*by, "point")


WIDE = 12  # columns from which on the pairs' sums are taken as matrix products


def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation, pairwise-complete, as a long table (x, y, corr).

    Means first (one aggregate), then every pair's sums of centred values, squares and products in one pass; a constant
    column gives null instead of a division error. Few columns are summed by an aggregate expression per pair, many as
    products of blocks of rows (:func:`_gram`), whose number of partial results does not grow with the rows."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    xs = {c: as_double(df, c) for c in cols}
    means = df.agg(*[F.avg(xs[c]).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    mean = [means[f"m{i}"] if means[f"m{i}"] is not None and math.isfinite(means[f"m{i}"]) else 0.0 for i in range(len(cols))]
    cen = df.select(*[(xs[c] - F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(cols, mean))])
    sums = _gram(cen, len(cols)) if len(cols) > WIDE else _pair_sums(cen, len(cols))
    n = F.col("n").cast("double")
    cov = F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), n)
    va = F.col("saa") - F.try_divide(F.col("sa") * F.col("sa"), n)
    vb = F.col("sbb") - F.try_divide(F.col("sb") * F.col("sb"), n)
    # a product of two tiny variances would vanish: roots first
    r = F.when((va > 0) & (vb > 0) & (n > 1), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))
    # clamp rounding overshoot; least/greatest would turn null into a bound
    r = F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    name = F.array(*map(F.lit, cols))
    both = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    pairs = sums.select(r.alias("corr"), F.explode(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)).alias("p"))
    return pairs.select(name[F.col("p.a")].alias("x"), name[F.col("p.b")].alias("y"), "corr")


def _pair_sums(cen: DataFrame, k: int) -> DataFrame:
    """``(i, j, n, sa, sb, sab, saa, sbb)`` of every pair i <= j of columns, over the rows that have both."""
    aggs, structs = [], []
    for i in range(k):
        for j in range(i, k):
            both = F.col(f"x{i}").isNotNull() & F.col(f"x{j}").isNotNull()
            a, b = F.when(both, F.col(f"x{i}")), F.when(both, F.col(f"x{j}"))
            sums = {"n": F.count(a), "sa": F.sum(a), "sb": F.sum(b), "sab": F.sum(a * b), "saa": F.sum(a * a), "sbb": F.sum(b * b)}
            aggs += [s.alias(f"{n}_{i}_{j}") for n, s in sums.items()]
            structs.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.col(f"{n}_{i}_{j}").alias(n) for n in sums]))
    return cen.agg(*aggs).select(F.inline(F.array(*structs)))


def _gram(cen: DataFrame, k: int) -> DataFrame:
    """The same sums by matrix products: with X the values (0 where missing) and M their mask, X'X, X'M, (X*X)'M and M'M hold
    every pair's. A task adds its blocks up and gives one row per pair."""
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(k)]).astype(float)
            m = ~np.isnan(x)  # missing values are null, which numpy reads as NaN
            x, m = np.where(m, x, 0.0), m.astype(float)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, (x * x).T @ m, m.T @ (x * x)])
            total = part if total is None else total + part
        if total is not None:
            cells = [t[i, j] for t in total]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, cells)],
                                             names=["i", "j", "n", "sa", "sb", "sab", "saa", "sbb"])

    names = ("n", "sa", "sb", "sab", "saa", "sbb")
    parts = cen.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """G10 as a square table (one row per column), like ``DataFrame.corr()``."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = correlation(df, cols)
    return long.groupBy("x").pivot("y", cols).agg(F.first("corr")).withColumnRenamed("x", "column")


def pie_shares(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each category (null category dropped)."""
    # one row per category: checkpointed, so that total and shares come from the counts and not from the table again
    counts = cut_lineage(df.where(q(col).isNotNull()).groupBy(q(col).alias(col)).agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.select(col, "count", F.try_divide(F.col("count").cast("double"), F.lit(float(total))).alias("share")).orderBy(col)


def sample_rows(df: DataFrame, max_points: int | None, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """At most ``max_points`` rows: exactly that many if there are more, drawn by a hash of ``key`` or, without one, of the row
    and its number among equal rows - so points that many rows share are drawn in proportion."""
    return sample(df, max_points, key, seed) if max_points else df


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None,
                   max_points: int | None = None, seed: int = 42) -> DataFrame:
    """The (x, y[, color]) pairs of a scatter chart."""
    cols = [x, y] + ([color] if color else [])
    return sample_rows(df.select(*[q(c) for c in cols]), max_points, seed)


def scatter3d_points(df: DataFrame, x: str | None = None, y: str | None = None, z: str | None = None,
                     color: str | None = None, max_points: int | None = None, seed: int = 42) -> DataFrame:
    """(x, y, z) triples; first three numeric columns by default."""
    num = numeric_columns(df)
    x, y, z = x or num[0], y or num[1], z or num[2]
    cols = [x, y, z] + ([color] if color else [])
    return sample_rows(df.select(*[q(c) for c in cols]), max_points, seed)
