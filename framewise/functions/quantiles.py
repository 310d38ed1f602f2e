"""Exact, interpolated quantiles by radix selection, without holding a group in one task.

Spark's ``percentile`` and ``median`` keep a map of every distinct value of a group in one task, which does not survive a
global median over a large table. Here each double is read as its order-preserving 64-bit image (:func:`image`: smaller
values have smaller images, infinities included), and the wanted order statistics are found digit by digit:

1. the first pass counts values by the top 16 bits of their image, per group and column: at most 2^16 counts, combined on
   the map side, so a value that a third of the rows hold is one row of the shuffle. The counts' running sum tells the
   number of values, which ranks are wanted, and which bin holds each of them;
2. every further pass looks only at values inside those bins and counts them by 16 more bits. A bin of at most 2^16 values
   is counted by all its remaining bits at once. A bin whose smallest and largest value are the same is decided.

64 bits make four passes at most, whatever the values; two are usual below 10^9 rows. Columns of one call share the scans.
A rank's bins are literals of the next pass when there are no groups (a handful, given by the call's arguments), and a
checkpointed table joined by group otherwise - broadcast only if its measured size is small. Between the two order
statistics around ``p * (n - 1)`` the value is interpolated linearly, as pandas does. ``approx=True`` uses
``percentile_approx`` instead (one pass, not interpolated).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.columns import as_double, join_sized, q, table_size
from framewise.session import cut_lineage

DIGIT = 16  # bits per pass


def image(x: Column) -> Column:
    """The IEEE bits of a double as a long that orders as the doubles do (-0.0 and 0.0 are equal; null stays null).

    Exact: dividing by a power of two loses nothing, and the estimate of the exponent is corrected by comparison."""
    a = F.abs(x)
    e = F.floor(F.log2(a))
    return _image(x, a, e, F.pow(F.lit(2.0), e))


def _image(x: Column, a: Column, e: Column, w: Column) -> Column:
    """:func:`image` from the magnitude, its estimated exponent and two to that power. The estimate is at most one off."""
    m = a / w
    up, down = m >= 2, m < 1
    part = F.when(up, m / 2).when(down, m * 2).otherwise(m)
    normal = (e + F.when(up, 1).when(down, -1).otherwise(0) + 1023) * F.lit(1 << 52) + ((part - 1) * F.lit(2.0 ** 52)).cast("long")
    # 2^1024 is no double: the estimate for the largest values is corrected from half of it
    large = F.lit(2046 * (1 << 52)) + ((a / F.lit(2.0 ** 1023) - 1) * F.lit(2.0 ** 52)).cast("long")
    bits = (F.when(a == F.lit(math.inf), F.lit(2047 << 52)).when(a >= F.lit(2.0 ** 1023), large)
            .when(a < F.lit(2.0 ** -1022), (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")).otherwise(normal))
    return F.when(x < 0, -bits).otherwise(bits)


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), approx: bool = False,
                   accuracy: int = 10_000) -> DataFrame:
    """Quantiles as a long table ``(by..., column, prob, value)``.

    Nulls and NaN are no values; rows with a null in ``by`` are left out. Without ``by`` a column without values gets null
    for every prob; with ``by`` a group without values gets no row. Between a finite value and an infinity the result is
    the infinity."""
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    keys = [f"_k{i}" for i in range(len(by))]
    values = df.select(*[q(b).alias(k) for b, k in zip(by, keys)], *[as_double(df, c).alias(f"_x{i}") for i, c in enumerate(cols)])
    for k in keys:
        values = values.where(F.col(k).isNotNull())
    if not approx:
        values = _with_images(values, len(cols))
    if approx:
        found = _approximate(values, len(cols), probs, keys, accuracy)
    elif by:
        found = _grouped(values, len(cols), probs, keys)
    else:
        found = _global(values, len(cols), probs)
    name, prob = F.array(*map(F.lit, cols)), F.array(*map(F.lit, probs))
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], name[F.col("_c")].alias("column"),
                        prob[F.col("_i")].alias("prob"), "value")


def _with_images(values: DataFrame, n_cols: int) -> DataFrame:
    """``_u0``, ``_u1``, .. beside the values: :func:`image` in steps, so that each logarithm and power is taken once."""
    a = [F.abs(f"_x{i}") for i in range(n_cols)]
    v = values.withColumns({f"_e{i}": F.floor(F.log2(a[i])) for i in range(n_cols)})
    v = v.withColumns({f"_w{i}": F.pow(F.lit(2.0), F.col(f"_e{i}")) for i in range(n_cols)})
    return v.withColumns({f"_u{i}": _image(F.col(f"_x{i}"), a[i], F.col(f"_e{i}"), F.col(f"_w{i}")) for i in range(n_cols)}).drop(
        *[f"_{c}{i}" for c in "ew" for i in range(n_cols)])


def _approximate(values: DataFrame, n_cols: int, probs: list[float], keys: list[str], accuracy: int) -> DataFrame:
    row = values.groupBy(*keys).agg(*[F.percentile_approx(f"_x{i}", probs, accuracy).alias(f"_x{i}") for i in range(n_cols)])
    nulls = F.array(*[F.lit(None).cast("double")] * len(probs))
    per_col = row.select(*keys, F.posexplode(F.array(*[F.coalesce(f"_x{i}", nulls) for i in range(n_cols)])).alias("_c", "_q"))
    out = per_col.select(*keys, "_c", F.posexplode("_q").alias("_i", "value"))
    return out.where(F.col("value").isNotNull()) if keys else out


def _counted(items: DataFrame, keys: list[str], band: list[str]) -> DataFrame:
    """Values per bin with the number of values in the smaller bins of the same band (``_before``) and in all (``_n``)."""
    bins = items.groupBy(*keys, *band, "_bin").agg(F.count(F.lit(1)).alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    w = Window.partitionBy(*keys, *band)
    upto = F.sum("_m").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    return bins.withColumns({"_before": upto - F.col("_m"), "_n": F.sum("_m").over(w)})


def _first_pass(values: DataFrame, n_cols: int, probs: list[float], keys: list[str]) -> DataFrame:
    """The bins that hold a wanted rank: ``(keys, _c, _p, _n, _m, _below, _lo, _hi, _ranks)``. ``_p`` is the image's prefix,
    ``_ranks`` lists (number of the wanted rank, rank): 2 * i and 2 * i + 1 are the ranks around the i-th prob."""
    seen = F.array_compact(F.array(*[
        F.when(F.col(f"_x{i}").isNotNull(), F.struct(F.lit(i).alias("_c"), F.shiftright(f"_u{i}", 64 - DIGIT).alias("_bin"),
                                                     F.col(f"_x{i}").alias("_x"))) for i in range(n_cols)]))
    bins = _counted(values.select(*keys, F.inline(seen)), keys, ["_c"])
    at = lambda p: F.lit(p) * (F.col("_n") - 1)
    ranks = F.array(*[F.struct(F.lit(2 * i + side).alias("i"), f(at(p)).cast("long").alias("r"))
                      for i, p in enumerate(probs) for side, f in ((0, F.floor), (1, F.ceil))])
    return _with_ranks(bins.withColumns({"_ranks": ranks, "_below": F.lit(0).cast("long"), "_p": F.lit(0).cast("long")}), keys)


def _with_ranks(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Bins that hold a rank of their band, as the next pass's bands."""
    first = F.col("_below") + F.col("_before")
    here = F.filter("_ranks", lambda r: (r["r"] >= first) & (r["r"] < first + F.col("_m")))
    return (bins.withColumn("_ranks", here).where(F.size("_ranks") > 0)
            .select(*keys, "_c", F.col("_bin").alias("_p"), "_n", "_m", first.alias("_below"), "_lo", "_hi", "_ranks"))


def _next_shift(m: Column, shift: int) -> Column:
    """Bits of the image that the next pass leaves out: none if the bin is small enough to be counted by all of them."""
    return F.when(m <= 1 << DIGIT, 0).otherwise(shift - DIGIT)


def _global(values: DataFrame, n_cols: int, probs: list[float]) -> DataFrame:
    """Without groups: the state is a few rows, bounded by columns x probs."""
    spark, found, n = values.sparkSession, {}, {}
    first = _first_pass(values, n_cols, probs, [])
    state, shift = first.collect(), 64 - DIGIT
    while state:
        bands = []
        for r in state:
            n[r["_c"]] = r["_n"]
            if r["_lo"] == r["_hi"]:
                found.update({(r["_c"], k["i"]): r["_lo"] for k in r["_ranks"]})
            else:
                bands.append((r["_c"], r["_p"], r["_n"], r["_m"], r["_below"], [tuple(k) for k in r["_ranks"]]))
        if not bands:
            break
        inside = []
        for i in sorted({b[0] for b in bands}):
            u, x = F.col(f"_u{i}"), F.col(f"_x{i}")
            p = F.shiftright(u, shift)
            for c, prefix, _, m, _, _ in bands:
                if c == i:
                    to = 0 if m <= 1 << DIGIT else shift - DIGIT
                    inside.append(F.when(p == F.lit(prefix), F.struct(F.lit(i).alias("_c"), p.alias("_p"),
                                                                      F.shiftright(u, to).alias("_bin"), x.alias("_x"))))
        bins = _counted(values.select(F.inline(F.array_compact(F.array(*inside)))), [], ["_c", "_p"]).drop("_n")
        table = spark.createDataFrame(bands, "_c int, _p long, _n long, _size long, _below long, _ranks array<struct<i:int,r:long>>")
        state = _with_ranks(bins.join(F.broadcast(table), ["_c", "_p"]), []).collect()  # as many rows as the arguments ask for
        shift -= DIGIT
    rows = []
    for c in range(n_cols):
        for i, p in enumerate(probs):
            a, b = found.get((c, 2 * i)), found.get((c, 2 * i + 1))
            rows.append((c, i, None if a is None else _between(a, b, p * (n[c] - 1))))
    return spark.createDataFrame(rows, "_c int, _i int, value double")


def _between(a: float, b: float, at: float) -> float:
    part = at - math.floor(at)
    return a if a == b or part == 0 else b if math.isinf(b) else a if math.isinf(a) else a + (b - a) * part


def _grouped(values: DataFrame, n_cols: int, probs: list[float], keys: list[str]) -> DataFrame:
    """With groups: the state is a table with a few rows per group and column."""
    state, shift = cut_lineage(_first_pass(values, n_cols, probs, keys)), 64 - DIGIT
    done = state.where(F.col("_lo") == F.col("_hi"))
    while shift > 0:
        bands = state.where(F.col("_lo") < F.col("_hi"))
        size = table_size(bands.select(*keys, "_c", "_p", "_n"))
        if not size.rows:
            break
        per_group = bands.groupBy(*keys).agg(F.collect_list(F.struct("_c", "_p", _next_shift(F.col("_m"), shift).alias("_to"))).alias("_b"))
        joined = join_sized(values, per_group, keys, size)
        u = F.array(*[F.col(f"_u{i}") for i in range(n_cols)])
        x = F.array(*[F.col(f"_x{i}") for i in range(n_cols)])
        joined = joined.withColumns({"_us": u, "_xs": x})
        inside = F.filter("_b", lambda b: F.shiftright(F.col("_us")[b["_c"]], shift) == b["_p"])
        item = F.transform(inside, lambda b: F.struct(b["_c"].alias("_c"), b["_p"].alias("_p"), F.call_function(
            "shiftright", F.col("_us")[b["_c"]], b["_to"]).alias("_bin"), F.col("_xs")[b["_c"]].alias("_x")))
        bins = _counted(joined.select(*keys, F.inline(item)), keys, ["_c", "_p"]).drop("_n")
        wanted = bands.select(*keys, "_c", "_p", "_n", "_below", "_ranks")
        state = cut_lineage(_with_ranks(bins.join(wanted, [*keys, "_c", "_p"]), keys))
        done = done.unionByName(state.where(F.col("_lo") == F.col("_hi")))
        shift -= DIGIT
    ranks = done.select(*keys, "_c", "_n", "_lo", F.explode("_ranks.i").alias("_r"))
    prob = F.array(*map(F.lit, probs))
    two = ranks.groupBy(*keys, "_c", "_n", F.shiftright("_r", 1).alias("_i")).agg(
        F.max(F.when(F.col("_r") % 2 == 0, F.col("_lo"))).alias("_a"), F.max(F.when(F.col("_r") % 2 == 1, F.col("_lo"))).alias("_b"))
    at = prob[F.col("_i")] * (F.col("_n") - 1)
    part, a, b, inf = at - F.floor(at), F.col("_a"), F.col("_b"), F.lit(math.inf)
    value = F.when((a == b) | (part == 0), a).when(F.abs(b) == inf, b).when(F.abs(a) == inf, a).otherwise(a + (b - a) * part)
    return two.select(*keys, "_c", "_i", value.alias("value"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              approx: bool = False) -> dict[tuple[str, float], float | None]:
    """Global quantiles as a small driver dict {(column, prob): value}."""
    rows = quantile_table(df, cols, probs, approx=approx).collect()
    return {(r["column"], r["prob"]): r["value"] for r in rows}


def median_table(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                 approx: bool = False) -> DataFrame:
    return quantile_table(df, cols, [0.5], by=by, approx=approx).drop("prob")
