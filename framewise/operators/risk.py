"""W7, re-aimed: bands of where a value may go, from what every key's own history did.

The reference draws made-up random paths from the mean and deviation of the returns. Here the spread over ``h`` rows is that of
all returns over ``h`` rows that the table holds, key by key: a window of lags over the ordered rows and exact grouped
quantiles, so the work grows with the data and nothing is simulated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import as_double, join_small, q
from framewise.functions.quantiles import quantile_table
from framewise.plans.ordered import local_window, with_halo
from framewise.session import cut_lineage


def risk_bands(df: DataFrame, price: str, order_by: Sequence[str], keys: Sequence[str] = (), days: int = 252,
               probs: Sequence[float] = (0.05, 0.5, 0.95), n_buckets: int | None = None) -> DataFrame:
    """``(keys..., day, n, p05, p50, p95)`` for day 0 (the last value) to ``days``: the last value times the quantiles of the
    growth over so many rows, and the number ``n`` of such growths. Missing values and growth from zero are left out; a day
    with no growth has no row."""
    keys, ob = list(keys), list(order_by)
    rows = df.select(*[q(c) for c in keys + ob], as_double(df, price).alias("_v"))
    h = with_halo(rows, ob, keys, days, n_buckets, ["_v"])
    lags = {f"_l{k}": F.lag("_v", k).over(local_window(keys, ob)) for k in range(1, days + 1)}
    seen = h.withColumns(lags).where(~F.col("_halo"))
    pairs = F.array(*[F.struct(F.lit(k).alias("day"), F.try_divide(F.col("_v"), F.col(f"_l{k}")).alias("_growth")) for k in range(1, days + 1)])
    # the quantile passes read the growths several times: they are written once
    growth = cut_lineage(seen.select(*[q(c) for c in keys], F.inline(pairs)).where(F.col("_growth").isNotNull()))
    by = keys + ["day"]
    bands = quantile_table(growth, ["_growth"], probs, by=by).groupBy(*[q(c) for c in by]).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(_name(p)) for p in probs])
    counts = growth.groupBy(*[q(c) for c in by]).agg(F.count(F.lit(1)).alias("n"))
    last = rows.groupBy(*[q(c) for c in keys]).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*[q(c) for c in ob]))).alias("_last"))
    spread = counts.join(bands, by)
    if keys:
        spread = join_small(spread, last, keys)
    else:
        spread = spread.withColumn("_last", F.lit(last.first()["_last"]))
    now = last.select(*[q(c) for c in keys], F.lit(0).alias("day"), F.lit(0).cast("long").alias("n"), *[F.col("_last").alias(_name(p)) for p in probs])
    later = spread.select(*[q(c) for c in keys], "day", "n", *[(F.col("_last") * F.col(_name(p))).alias(_name(p)) for p in probs])
    return now.unionByName(later).orderBy(*[q(c) for c in keys], "day")


def _name(p: float) -> str:
    return f"p{round(p * 100):02d}"
