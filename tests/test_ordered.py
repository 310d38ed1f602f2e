"""The bucketed scheme must equal a plain global window."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.operators import finance
from framewise.plans import ordered as od


@pytest.fixture(scope="module")
def gaps(spark):
    # nulls at both ends and runs of nulls across bucket edges
    vals = [None, None, 1.0, None, None, None, 4.0, 5.0, None, None, None, None, 9.0, None, None]
    rows = [(i, (i % 3), v) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "i int, g int, x double")


@pytest.mark.parametrize("nb", [1, 7])
def test_ffill_bfill_equal_plain(spark, gaps, nb):
    pdf = gaps.toPandas().sort_values("i")
    f = od.ffill(gaps, ["i"], n_buckets=nb).toPandas().sort_values("i")
    b = od.bfill(gaps, ["i"], n_buckets=nb).toPandas().sort_values("i")
    assert f.x.tolist() == pdf.x.ffill().tolist() or f.x.isna().tolist() == pdf.x.ffill().isna().tolist()
    pd.testing.assert_series_equal(f.x.reset_index(drop=True), pdf.x.ffill().reset_index(drop=True))
    pd.testing.assert_series_equal(b.x.reset_index(drop=True), pdf.x.bfill().reset_index(drop=True))


@pytest.mark.parametrize("nb", [5])
def test_partitioned_ffill(spark, gaps, nb):
    got = od.ffill(gaps, ["i"], ["g"], n_buckets=nb).toPandas().sort_values("i")
    exp = gaps.toPandas().sort_values("i")
    exp["x"] = exp.groupby("g").x.ffill()
    pd.testing.assert_series_equal(got.x.reset_index(drop=True), exp.x.reset_index(drop=True))


@pytest.mark.parametrize("nb", [9])
def test_lag_rolling_cumsum_rowindex(spark, nb):
    rows = [(i, float((i * 37) % 11) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x double")
    pdf = pd.DataFrame(rows, columns=["i", "x"])
    lag = od.lag_value(df, "x", ["i"], k=3, out="l", n_buckets=nb).toPandas().sort_values("i")
    pd.testing.assert_series_equal(lag.l.reset_index(drop=True), pdf.x.shift(3), check_names=False)
    roll = od.rolling_mean(df, "x", 4, ["i"], out="r", n_buckets=nb).toPandas().sort_values("i")
    pd.testing.assert_series_equal(roll.r.reset_index(drop=True), pdf.x.rolling(4).mean(), check_names=False)
    cs = od.running_sum(df, "x", ["i"], out="c", n_buckets=nb).toPandas().sort_values("i")
    pd.testing.assert_series_equal(cs.c.reset_index(drop=True), pdf.x.cumsum(), check_names=False)
    ri = od.row_index(df, ["i"], n_buckets=nb).toPandas().sort_values("i")
    assert ri.row_index.tolist() == list(range(60))


def test_pct_change_and_sma_match_pandas(spark):
    prices = [100.0, 101.0, 99.0, 0.0, 5.0, 7.0, 7.5, 8.0, 8.5, 9.0] * 3
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prices)], "t int, p double")
    r = finance.pct_change(df, "p", ["t"], dropna=False, n_buckets=4).toPandas().sort_values("t")
    exp = pd.Series(prices).pct_change()
    exp = exp.where(pd.Series(prices).shift(1) != 0)  # zero previous price -> null
    pd.testing.assert_series_equal(r.p_return.reset_index(drop=True), exp, check_names=False)
    s = finance.sma(df, "p", ["t"], 20, n_buckets=4).toPandas().sort_values("t")
    pd.testing.assert_series_equal(s.p_sma20.reset_index(drop=True), pd.Series(prices).rolling(20).mean(),
                                   check_names=False)


def test_no_single_partition_window(spark, gaps):
    for df in (od.ffill(gaps, ["i"], n_buckets=4), od.bfill(gaps, ["i"], n_buckets=4),
               od.rolling_mean(gaps, "x", 3, ["i"], n_buckets=4), od.running_sum(gaps, "x", ["i"], n_buckets=4)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        assert "hashpartitioning(_ob" in plan


def made(seed, n=300):
    """A hot key, short keys, null keys and order values, nulls and NaN in the values; text, date and double order columns."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot"] * 12 + ["a", "b", "c", None, "d" + str(i)])
        x = rng.choice([None, float("nan"), float(rng.randrange(9)), float(rng.randrange(9))])
        rows.append((key, rng.choice([None, "same", "same", "same", "t"]), rng.choice([None, rng.random(), 2.5]), f"{i:04}", x,
                     rng.choice([None, f"v{i}"])))
    rng.shuffle(rows)
    return rows


SCHEMA = "k string, o1 string, o2 double, o3 string, x double, s string"
OB = ["o1", "o2", "o3"]


def plain(df, keyed):
    """The same operators by one window per key."""
    part = [F.col("k")] if keyed else [F.lit(1)]
    x = F.when(~F.isnan("x"), F.col("x"))
    w = Window.partitionBy(*part).orderBy(*OB)
    upto, last3 = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-2, 0)
    after = Window.partitionBy(*part).orderBy(*OB).rowsBetween(0, Window.unboundedFollowing)
    return {r["o3"]: r for r in df.select(
        "o3", F.last(x, True).over(upto).alias("fx"), F.last("s", True).over(upto).alias("fs"), F.first(x, True).over(after).alias("bx"),
        F.first("s", True).over(after).alias("bs"), F.lag(x, 5).over(w).alias("lag"), F.sum(x).over(upto).alias("sum"),
        F.when(F.count(x).over(last3) >= 2, F.avg(x).over(last3)).alias("roll"), (F.row_number().over(w) - 1).alias("row"),
        x.alias("x")).collect()}


@pytest.mark.parametrize("nb, span, keyed", [(1, 1024, True), (40, 3, True), (6, 1024, True), (200, 4, False), (2, 1024, False)])
def test_any_order_tuple_and_skewed_keys_equal_plain_windows(spark, monkeypatch, nb, span, keyed):
    monkeypatch.setattr(od, "SPAN", span)
    df = spark.createDataFrame(made(nb + keyed), SCHEMA).repartition(3)
    want = plain(df, keyed)
    by = ["k"] if keyed else None
    same = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) < 1e-9)
    f = od.ffill(df, OB, by, ["x", "s"], nb).collect()
    b = od.bfill(df, OB, by, ["x", "s"], nb).collect()
    assert len(f) == len(b) == 300
    assert all(same(r["x"], want[r["o3"]]["fx"]) and r["s"] == want[r["o3"]]["fs"] for r in f)
    assert all(same(r["x"], want[r["o3"]]["bx"]) and r["s"] == want[r["o3"]]["bs"] for r in b)
    assert all(same(r["l"], want[r["o3"]]["lag"]) for r in od.lag_value(df, "x", OB, by, 5, "l", nb).collect())
    rolled = od.rolling_mean(df, "x", 3, OB, by, "m", 2, nb)
    assert rolled.columns == df.columns + ["m"] and all(same(r["m"], want[r["o3"]]["roll"]) for r in rolled.collect())
    sums = od.running_sum(df, "x", OB, by, "c", nb).collect()
    assert len(sums) == 300
    assert all(same(r["c"], want[r["o3"]]["sum"] if want[r["o3"]]["x"] is not None else None) for r in sums)
    assert all(r["row_index"] == want[r["o3"]]["row"] for r in od.row_index(df, OB, by, n_buckets=nb).collect())


def test_one_first_value_is_cut_into_even_buckets(spark):
    df = spark.range(40_000).select(F.lit("x").alias("a"), F.concat(F.lit("t"), F.col("id")).alias("b"))
    sizes = [r["count"] for r in od.ranges(df, ["a", "b"], n_buckets=8).rows.groupBy("_ob").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8


def test_empty_and_all_equal(spark):
    df = spark.createDataFrame([], "i int, x double")
    assert od.ffill(df, ["i"], n_buckets=4).count() == 0 and od.row_index(df, ["i"]).count() == 0
    same = spark.createDataFrame([(1, 2.0)] * 5, "i int, x double")
    assert sorted(r["row_index"] for r in od.row_index(same, ["i"], n_buckets=4).collect()) == [0, 1, 2, 3, 4]
