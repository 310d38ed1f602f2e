"""Hand-made fixtures from FIXTURES.md."""

import math

import pytest
from pyspark.sql import functions as F

from framewise.functions import scalar as sc
from framewise.functions.distributions import chi2_1df_p, t_two_sided_p
from framewise.operators import charts, clean, columns, profile, stats
from framewise.sources import nested


def test_empty_table(spark):
    df = spark.createDataFrame([], "num double, cat string, t timestamp")
    o = profile.overview(df).first()
    assert (o["rows"], o["columns"], o["missing_cells"], o["duplicate_rows"]) == (0, 3, 0, 0)
    assert charts.histogram(df, "num").count() == 0


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, None, None)] * 3, "num double, cat string, t timestamp")
    assert charts.grouped_stats(df.withColumn("g", F.lit("a")), "g", "num", "sum").first()["num"] == 0.0
    assert clean.column_modes(df, ["cat"])["cat"] is None
    d = profile.describe(df, ["num"]).first()
    assert d["count"] == 0 and d["mean"] is None and d["50%"] is None
    out = sc.datetime_features_checked(df, "t", ["Year"])
    assert "t_Year" not in out.columns


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    corr = {(r["x"], r["y"]): r["corr"] for r in charts.correlation(df).collect()}
    assert corr[("a", "b")] is None and corr[("b", "b")] is None and corr[("a", "a")] == pytest.approx(1.0)
    from framewise.operators.ml import standard_scale
    assert [r["b"] for r in standard_scale(df, ["b"]).collect()] == [0.0, 0.0, 0.0]
    assert clean.zscore_remove(df, ["b"]).count() == 3


def test_nan_and_null_both_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert profile.overview(df).first()["missing_cells"] == 2
    assert clean.drop_missing(df).count() == 2
    filled = [r["x"] for r in clean.fill_mean(df).collect()]
    assert filled == [1.0, 2.0, 2.0, 3.0]


def test_single_row_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, x double")
    std = {r["g"]: r["x"] for r in charts.grouped_stats(df, "g", "x", "std").collect()}
    assert std["b"] is None
    t = stats.welch_ttest(df, "x", "g", "a", "b").first()
    assert t["t"] is None and t["p_value"] is None


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string")
    assert clean.column_modes(df, ["c"])["c"] == "a"
    assert profile.categorical_insights(df).first()["top_value"] == "a"


def test_nested_flatten(spark):
    df = spark.createDataFrame([(1, (2, ("x",)), [1, 2])],
                               "id int, a struct<b:int, c:struct<d:string>>, e array<int>")
    flat = nested.flatten_json(df)
    assert flat.columns == ["id", "a.b", "a.c.d", "e"]
    r = flat.first()
    assert r["a.b"] == 2 and r["a.c.d"] == "x" and r["e"] == [1, 2]


def test_email_rule(spark):
    df = spark.createDataFrame([("a.b@x.io",), ("bad@x",), ("@x.com",), (None,), ("ok+1@mail.example.org",)],
                               "s string")
    got = [r["s_valid"] for r in sc.valid_format(df, "s").collect()]
    assert got == [True, False, False, None, True]
    rep = sc.format_report(df, "s").first()
    assert (rep["rows"], rep["non_null"], rep["valid"]) == (5, 4, 2)


def test_strength_rule(spark):
    df = spark.createDataFrame([("short",), ("alllowercase1!",), ("NoDigits!!",), ("NoSpecial1a",), ("Good1pass!",)],
                               "p string")
    got = [r["p_failed_rule"] for r in sc.valid_format(df, "p", "strength").collect()]
    assert got == ["length", "uppercase", "number", "special", None]


def test_kpi_formatting(spark):
    df = spark.createDataFrame([(2_500_000.0,), (12_350.0,), (999.999,), (-5000.0,)], "v double")
    got = [r[0] for r in df.select(sc.format_kpi(F.col("v"))).collect()]
    assert got == ["2.50M", "12.3K", "1,000.00", "-5,000.00"]  # 12.35 is a little less in binary


def test_one_hot_null_all_false(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "c string, n int")
    out = columns.one_hot(df, ["c"])
    assert out.columns == ["n", "c_y"]
    assert [r["c_y"] for r in out.orderBy("n").collect()] == [False, True, False]


def test_iqr_sequential_vs_single_pass(spark):
    rows = [(float(i), float(i % 7)) for i in range(40)] + [(1000.0, 3.0), (5.0, 500.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    seq = clean.iqr_remove(df, ["a", "b"]).count()
    one = clean.iqr_remove(df, ["a", "b"], sequential=False).count()
    assert seq == one == 40


def test_pvalues_textbook():
    # t = 2.0 with 10 df: two-sided p = 0.07338803
    assert t_two_sided_p(2.0, 10.0) == pytest.approx(0.0733880, abs=1e-6)
    assert t_two_sided_p(-2.228138852, 10.0) == pytest.approx(0.05, abs=1e-7)
    assert chi2_1df_p(3.841458821) == pytest.approx(0.05, abs=1e-8)
    assert math.isclose(t_two_sided_p(0.0, 5.0), 1.0)


def test_kaplan_meier_textbook(spark):
    # durations 1,2,2,3,4 with the 4 censored: S = 0.8, 0.4, 0.2, 0.2
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 1), (3.0, 1), (4.0, 0)], "d double, e int")
    got = [(r["time"], r["at_risk"], r["survival"]) for r in stats.kaplan_meier(df, "d", "e").collect()]
    assert [g[1] for g in got] == [5, 4, 2, 1]
    assert [round(g[2], 10) for g in got] == [0.8, 0.4, 0.2, 0.2]


def test_kpi_delta_and_pad(spark):
    now = spark.createDataFrame([(10.0,), (20.0,)], "v double")
    before = spark.createDataFrame([(5.0,)], "v double")
    cards = {r["label"]: (r["value"], r["delta"]) for r in charts.kpi(now, ["v"], "Sum", before).collect()}
    assert cards == {"Total Rows": (2.0, 1.0), "Total v": (30.0, 25.0)}
    from framewise.operators import finance
    df = spark.createDataFrame([(0, 10.0), (1, None), (2, 12.0)], "t int, p double")
    padded = [r["p_return"] for r in finance.pct_change(df, "p", ["t"], pad_nulls=True, n_buckets=2)
              .orderBy("t").collect()]
    assert padded == [0.0, pytest.approx(0.2)]


def test_kpi_text_is_that_of_the_exact_value(spark):
    """Literal texts for ties, and Python's own formatting for random values."""
    import random
    literal = {1250.0: "1.2K", 1350.0: "1.4K", 1750.0: "1.8K", 0.125: "0.12", 0.375: "0.38", 1.005: "1.00", 999.995: "1,000.00", 999_950.0: "1000.0K",
               1_125_000.0: "1.12M", 2.675e6: "2.67M", -1250.5: "-1,250.50", 0.0: "0.00", -0.125: "-0.12", 1e15: "1000000000.00M", -12345678.905: "-12,345,678.90"}
    rng = random.Random(1)
    values = list(literal) + [rng.choice([1, -1]) * rng.random() * 10 ** rng.randrange(-3, 12) for _ in range(2000)]
    values += [round(rng.random() * 10 ** rng.randrange(0, 8), 3) for _ in range(2000)] + [k / 8 for k in range(400)] + [k * 12.5 for k in range(400)]

    def text(v):
        return f"{v / 1_000_000:.2f}M" if v >= 1_000_000 else f"{v / 1_000:.1f}K" if v >= 1_000 else f"{v:,.2f}"
    assert all(text(v) == t for v, t in literal.items())
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", sc.format_kpi(F.col("v")).alias("t")).collect()
    assert [(r["v"], r["t"]) for r in rows] == [(v, text(v)) for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double").select(sc.format_kpi(F.col("v"))).collect()
    assert [r[0] for r in odd] == [None, "nan", "infM", "-inf"]
