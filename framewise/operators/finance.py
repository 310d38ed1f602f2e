"""Returns, volatility, cumulative growth and moving averages along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import q
from framewise.plans.ordered import (BUCKET, lag_value, local_window, rolling_mean, running_sum,
                                     with_halo)
from framewise.session import cut_lineage


def pct_change(df: DataFrame, col: str, order_by: Sequence[str], partition_by: Sequence[str] | None = None,
               out: str | None = None, dropna: bool = True, pad_nulls: bool = False,
               n_buckets: int | None = None) -> DataFrame:
    """``x / previous x - 1`` along ``order_by``; a zero previous value gives
    null. ``dropna`` removes the rows without a return (the first row).
    ``pad_nulls=True`` forward-fills the prices first (older pandas' default)."""
    out = out or f"{col}_return"
    if pad_nulls:
        from framewise.plans.ordered import ffill
        df = cut_lineage(ffill(df, order_by, partition_by, [col], n_buckets))  # the next cut into ranges reads it several times
    lagged = lag_value(df, col, order_by, partition_by, 1, "_prev", n_buckets)
    r = lagged.withColumn(out, F.try_divide(q(col).cast("double"), F.col("_prev").cast("double")) - 1).drop("_prev")
    return r.where(F.col(out).isNotNull()) if dropna else r


def return_stats(df: DataFrame, col: str, order_by: Sequence[str], partition_by: Sequence[str] | None = None,
                 n_buckets: int | None = None) -> DataFrame:
    """Mean return and volatility (sample std) per partition key."""
    pb = list(partition_by or [])
    r = pct_change(df, col, order_by, pb, "_r", n_buckets=n_buckets)
    return r.groupBy(*[q(c) for c in pb]).agg(F.count("_r").alias("n_returns"),
                                               F.avg("_r").alias("mean_return"),
                                               F.stddev_samp("_r").alias("volatility"))


def asset_returns(df: DataFrame, cols: Sequence[str], order_by: Sequence[str],
                  partition_by: Sequence[str] | None = None, weights: Sequence[float] | None = None,
                  n_buckets: int | None = None) -> DataFrame:
    """W3 rows: each asset's period return and the weighted portfolio return.

    All assets' previous values come from one halo window. A row missing any
    asset's return has a null portfolio return (as index-aligned pandas does)."""
    pb, ob = list(partition_by or []), list(order_by)
    cols = list(cols)
    w = list(weights) if weights else [1.0 / len(cols)] * len(cols)
    d = with_halo(df.select(*[q(c) for c in pb + ob + cols]), ob, pb, 1, n_buckets, cols)
    win = local_window(pb, ob)
    rets = {f"{c}_return": F.try_divide(q(c).cast("double"), F.lag(q(c), 1).over(win).cast("double")) - 1
            for c in cols}
    r = d.withColumns(rets).where(~F.col("_halo")).drop("_halo", BUCKET)
    port = sum((F.col(f"{c}_return") * F.lit(wi) for c, wi in zip(cols, w)), F.lit(0.0))
    r = r.withColumn("portfolio_return", port)
    first_missing = F.lit(True)
    for c in cols:
        first_missing = first_missing & F.col(f"{c}_return").isNull()
    # the first row has no return for any asset: dropped, like pct_change().dropna()
    return r.where(~first_missing)


def portfolio_stats(df: DataFrame, cols: Sequence[str], order_by: Sequence[str],
                    partition_by: Sequence[str] | None = None, weights: Sequence[float] | None = None,
                    n_buckets: int | None = None) -> DataFrame:
    """Mean return of each asset and of the portfolio, portfolio volatility."""
    pb = list(partition_by or [])
    r = asset_returns(df, cols, order_by, pb, weights, n_buckets)
    aggs = [F.avg(f"{c}_return").alias(f"mean_{c}") for c in cols]
    aggs += [F.avg("portfolio_return").alias("mean_portfolio"),
             F.stddev_samp("portfolio_return").alias("volatility_portfolio")]
    return r.groupBy(*[q(c) for c in pb]).agg(*aggs)


def cumulative_growth(df: DataFrame, col: str, order_by: Sequence[str],
                      partition_by: Sequence[str] | None = None, out: str | None = None,
                      n_buckets: int | None = None) -> DataFrame:
    """``exp(cumulative sum of simple returns in col)`` - the reference's
    growth curve (an approximation of compounded growth, kept and named so)."""
    out = out or f"{col}_growth"
    s = running_sum(df, col, order_by, partition_by, "_cs", n_buckets)
    return s.withColumn(out, F.when(q(col).isNotNull(), F.exp("_cs"))).drop("_cs")


def cumulative_returns(df: DataFrame, cols: Sequence[str], order_by: Sequence[str],
                       partition_by: Sequence[str] | None = None, weights: Sequence[float] | None = None,
                       n_buckets: int | None = None) -> DataFrame:
    """W4 on the portfolio of W3: one row per period with the growth curve."""
    pb, ob = list(partition_by or []), list(order_by)
    r = asset_returns(df, cols, ob, pb, weights, n_buckets)
    # written once, narrow: the running sum cuts it into ranges again, which reads it several times
    r = cut_lineage(r.select(*[q(c) for c in pb + ob], "portfolio_return"))
    return cumulative_growth(r, "portfolio_return", ob, pb, "cumulative_growth", n_buckets)


def sma(df: DataFrame, col: str, order_by: Sequence[str], n: int = 20,
        partition_by: Sequence[str] | None = None, out: str | None = None,
        n_buckets: int | None = None) -> DataFrame:
    """``n``-row simple moving average (null until the window holds n values)."""
    return rolling_mean(df, col, n, order_by, partition_by, out or f"{col}_sma{n}", n, n_buckets)


def last_sma(df: DataFrame, col: str, order_by: Sequence[str], n: int = 20,
             partition_by: Sequence[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """W5 as the reference reports it: the moving average at the last row,
    only when there are more than ``n`` rows (per partition key)."""
    pb, ob = list(partition_by or []), list(order_by)
    s = sma(df, col, ob, n, pb, "_sma", n_buckets)
    last = s.groupBy(*[q(c) for c in pb]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max_by("_sma", F.struct(*[q(c) for c in ob])).alias(f"last_sma{n}"))
    return last.where(F.col("rows") > n)
