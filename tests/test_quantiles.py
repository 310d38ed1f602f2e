import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.functions import quantiles as qt
from framewise.functions.quantiles import image, quantile_table

PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def _expected(values, p):
    s = pd.Series(values, dtype="float64").dropna().sort_values().tolist()
    if not s:
        return None
    at = p * (len(s) - 1)
    a, b = s[math.floor(at)], s[math.ceil(at)]
    if a == b or at == math.floor(at):
        return a
    return b if math.isinf(b) else a if math.isinf(a) else a + (b - a) * (at - math.floor(at))


def _same(got, want):
    return got == want or (got is not None and want is not None and math.isclose(got, want, rel_tol=1e-12))


def test_image_has_the_order_of_doubles(spark):
    rng = random.Random(1)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    values += [float(2.0 ** k * m) for k in range(-1074, 1023, 7) for m in (1, 1 - 2 ** -53, 1 + 2 ** -52)]
    values += [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.0 ** -1022, 1.7976931348623157e308, 1.0, 0.1]
    values = [v for v in values if not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", image(F.col("x")).alias("u")).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["u"] == (-bits if r["x"] < 0 else bits), r


@pytest.mark.parametrize("digit", [4, 8, 16])
def test_global_quantiles_match_pandas(spark, monkeypatch, digit):
    # few bits a pass make many passes, as a very large table would
    monkeypatch.setattr(qt, "DIGIT", digit)
    rng = np.random.default_rng(7)
    a = [float(v) for v in rng.exponential(10, 500).round(3)] + [5.0] * 200 + [None, float("nan")]
    b = [float(v) for v in rng.normal(0, 1e9, 700)] + [0.0, -0.0]
    df = spark.createDataFrame(list(zip(a, b)), "x double, y double")
    got = {(r["column"], r["prob"]): r["value"] for r in quantile_table(df, ["x", "y"], PROBS).collect()}
    for c, vals in (("x", a), ("y", b)):
        for p in PROBS:
            assert _same(got[c, p], _expected(vals, p)), (c, p)


def test_infinities_are_values(spark, monkeypatch):
    monkeypatch.setattr(qt, "DIGIT", 8)
    vals = [math.inf] * 40 + [-math.inf] * 30 + [float(i) for i in range(50)] + [1e300, 1e-300, -1e300]
    df = spark.createDataFrame([(v, "g") for v in vals], "x double, g string")
    for res in (quantile_table(df, ["x"], PROBS), quantile_table(df, ["x"], PROBS, by=["g"])):
        got = {r["prob"]: r["value"] for r in res.collect()}
        assert all(_same(got[p], _expected(vals, p)) for p in PROBS), got


@pytest.mark.parametrize("digit, limit", [(16, 8 << 20), (8, 8 << 20), (8, 0)])
def test_groups_hot_many_and_not_broadcast(spark, monkeypatch, digit, limit):
    from framewise.functions import columns
    monkeypatch.setattr(qt, "DIGIT", digit)
    monkeypatch.setattr(columns, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(1)
    rows = [("hot", float(v), float(i % 7)) for i, v in enumerate(rng.normal(0, 1, 3000))]
    rows += [(f"g{i % 9}", float(v), None) for i, v in enumerate(rng.gamma(2.0, 3.0, 900).round(2))]
    rows += [("one", 2.0, 1.0), ("none", None, float("nan")), (None, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "_x0 string, x double, _c double")
    res = quantile_table(df, ["x", "_c"], [0.1, 0.5, 0.9], by=["_x0"]).collect()
    pdf = pd.DataFrame(rows, columns=["g", "x", "_c"])
    want = {(g, c, p): _expected(sub[c], p) for g, sub in pdf.groupby("g") for c in ("x", "_c") for p in (0.1, 0.5, 0.9)
            if sub[c].notna().any()}
    assert {(r["_x0"], r["column"], r["prob"]) for r in res} == set(want) and len(res) == len(want)
    assert all(_same(r["value"], want[r["_x0"], r["column"], r["prob"]]) for r in res)


def test_all_null_and_empty(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantile_table(df, ["x"], [0.5]).collect()[0]["value"] is None
    empty = spark.createDataFrame([], "x double")
    assert quantile_table(empty, ["x"], [0.25]).collect()[0]["value"] is None
    assert quantile_table(empty.withColumn("g", F.lit(1)), ["x"], [0.25], by=["g"]).count() == 0


def test_a_pass_shuffles_counts_only(spark):
    # one value in every row: the map side combines, so the shuffle holds a row per task
    df = spark.range(0, 200_000, 1, 8).select(F.lit(3.5).alias("x"))
    plan = qt._first_pass(qt._with_images(df.select(F.col("x").alias("_x0")), 1), 1, [0.5], [])
    assert plan.collect()[0]["_m"] == 200_000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text and "Join" not in text


def test_approx_is_close(spark):
    df = spark.range(10001).selectExpr("cast(id as double) x", "id % 2 as g")
    r = quantile_table(df, ["x"], [0.5], approx=True).collect()[0]["value"]
    assert abs(r - 5000) <= 5
    assert quantile_table(df, ["x"], [0.5], by=["g"], approx=True).count() == 2
