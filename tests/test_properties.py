"""Property checks for operators without a SQL twin."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import charts, forecast, risk


def test_violin_density_integrates_to_one(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    d = charts.violin_density(li, "l_extendedprice", "l_returnflag", points=256).toPandas()
    for _, g in d.groupby("l_returnflag"):
        g = g.sort_values("point")
        area = np.trapezoid(g.density, g.y)
        assert area == pytest.approx(1.0, abs=0.02)


def test_risk_bands_are_quantiles_of_the_own_history(spark):
    prices = [100 * (1.001 ** i) * (1 + 0.01 * ((i * 7919) % 13 - 6) / 6) for i in range(120)]
    rows = [("a", i, float(p)) for i, p in enumerate(prices)] + [("b", i, float(i)) for i in range(4)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, t int, p double")
    for n_buckets in (None, 7):
        got = {(r["k"], r["day"]): r for r in risk.risk_bands(df, "p", ["t"], ["k"], days=9, n_buckets=n_buckets).collect()}
        for h in range(1, 10):
            growth = [prices[i] / prices[i - h] for i in range(h, 120)]
            assert got["a", h]["n"] == 120 - h
            for p, name in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95")):
                assert got["a", h][name] == pytest.approx(prices[-1] * np.quantile(growth, p))
        assert got["a", 0]["p05"] == got["a", 0]["p95"] == prices[-1]
        assert sorted(d for k, d in got if k == "b") == [0, 1, 2]  # growth from zero is none
    alone = risk.risk_bands(df.where("k = 'a'"), "p", ["t"], days=3).collect()
    assert [r["day"] for r in alone] == [0, 1, 2, 3] and alone[2]["p50"] == pytest.approx(got["a", 2]["p50"])


def test_ar1_recovered_and_forecast(spark):
    rng = np.random.default_rng(11)
    phi, c, y = 0.6, 4.0, [10.0]
    for _ in range(3999):
        y.append(c + phi * y[-1] + rng.normal(0, 0.5))
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(days=i), v) for k in ("a", "b") for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, y double")
    fit = {r["k"]: r for r in forecast.arima_fit(df, "t", "y", ["k"], (1, 0, 0)).collect()}
    for k in ("a", "b"):
        assert fit[k]["ar"][0] == pytest.approx(phi, abs=0.05)
        assert fit[k]["const"] == pytest.approx(c, abs=0.6)
        assert fit[k]["n_train"] == fit[k]["n_fitted"] == 3200
        assert fit[k]["rmse"] == pytest.approx(0.5, abs=0.05)
    fc = forecast.arima_forecast(df, "t", "y", ["k"], (1, 0, 0), horizon=3).where(F.col("k") == "a") \
        .orderBy("step").toPandas()
    assert fc.Date.iloc[0] == t0 + dt.timedelta(days=4000)
    assert (fc["Lower CI"] < fc.Forecast).all() and (fc.Forecast < fc["Upper CI"]).all()
    widths = (fc["Upper CI"] - fc["Lower CI"]).tolist()
    assert widths[0] < widths[1] < widths[2]


def test_arma11_recovered(spark):
    rng = np.random.default_rng(21)
    phi, theta, e_prev, y = 0.5, 0.4, 0.0, [0.0]
    for _ in range(5999):
        e = rng.normal(0, 1.0)
        y.append(phi * y[-1] + e + theta * e_prev)
        e_prev = e
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=i), v) for i, v in enumerate(y)], "t timestamp_ntz, y double")
    r = forecast.arima_fit(df, "t", "y", [], (1, 0, 1)).first()
    assert r["ar"][0] == pytest.approx(phi, abs=0.08) and r["ma"][0] == pytest.approx(theta, abs=0.08)
    assert r["order"] == "(1,0,1)"
    fc = forecast.arima_forecast(df, "t", "y", [], (1, 1, 1), horizon=4).orderBy("step").toPandas()
    assert len(fc) == 4 and fc.Date.iloc[0] == t0 + dt.timedelta(hours=6000)
    assert (fc["Upper CI"] - fc["Lower CI"]).is_monotonic_increasing


def test_approx_flags_close_to_exact(spark, sf):
    from framewise.operators import clean, profile
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    exact = {r["column"]: r["unique"] for r in profile.column_info(li).collect()}
    approx = {r["column"]: r["unique"] for r in profile.column_info(li, approx=True).collect()}
    for c, n in exact.items():
        assert abs(approx[c] - n) <= max(3, 0.15 * n)  # HyperLogLog, 5% relative standard error
    e = clean.iqr_fences(li, ["l_extendedprice"])["l_extendedprice"]
    a = clean.iqr_fences(li, ["l_extendedprice"], approx=True)["l_extendedprice"]
    assert abs(a[0] - e[0]) < 0.05 * abs(e[1] - e[0]) and abs(a[1] - e[1]) < 0.05 * abs(e[1] - e[0])


def test_scatter_sample_bounded_and_deterministic(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    a = charts.scatter_points(li, "l_quantity", "l_extendedprice", max_points=500)
    b = charts.scatter_points(li, "l_quantity", "l_extendedprice", max_points=500)
    n = a.count()
    assert 300 <= n <= 700
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert charts.scatter_points(li, "l_quantity", "l_extendedprice").count() == li.count()


def test_correlation_matrix_square(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    m = charts.correlation_matrix(li, cols).toPandas().set_index("column").loc[cols, cols]
    assert np.allclose(np.diag(m.to_numpy()), 1.0)
    assert np.allclose(m.to_numpy(), m.to_numpy().T)
    ref = li.select(*cols).toPandas().corr().loc[cols, cols]
    assert np.allclose(m.to_numpy(), ref.to_numpy(), atol=1e-9)
