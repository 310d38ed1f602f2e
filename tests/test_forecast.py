"""ARIMA by exact likelihood against dense Gaussian algebra, blocks against whole series, calendar steps, stored models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.functions import arma, calendar
from framewise.operators import forecast as fc

T0 = dt.datetime(2024, 1, 1)


def simulated(phi, theta, n, seed, mean=0.0):
    e = np.random.default_rng(seed).normal(size=n + 400)
    x = np.zeros(n + 400)
    for t in range(4, n + 400):
        x[t] = sum(c * x[t - 1 - i] for i, c in enumerate(phi)) + e[t] + sum(c * e[t - 1 - j] for j, c in enumerate(theta))
    return x[400:] + mean


def dense(x, phi, theta, mean):
    """-2 log likelihood / n, mean, variance and one-step errors from the full covariance matrix."""
    n = len(x)
    cov = arma.before_cov(np.concatenate([phi, np.zeros(n - len(phi))]), np.array(theta))[:n, :n]
    inv, one = np.linalg.inv(cov), np.ones(n)
    mu = one @ inv @ x / (one @ inv @ one) if mean else 0.0
    s = (x - mu) @ inv @ (x - mu) / n
    root = np.linalg.cholesky(cov)
    return np.log(s) + np.linalg.slogdet(cov)[1] / n, mu, s, np.linalg.solve(root, x - mu) * np.diag(root)


@pytest.mark.parametrize("phi, theta", [([0.5], []), ([0.5, -0.3], [0.4]), ([], [0.7, 0.2]), ([0.9], [-0.6]), ([], [])])
@pytest.mark.parametrize("mean", [True, False])
def test_likelihood_and_errors_are_exact_over_any_blocks(phi, theta, mean):
    phi, theta = np.array(phi), np.array(theta)
    x = simulated(phi, theta, 150, 3, 1.5)
    want = dense(x, phi, theta, mean)
    for cuts in ([150], [70, 80], [40, 2, 1, 107]):
        parts, at = [], 0
        for c in cuts:
            parts.append(arma.summary(x[at:at + c], x[at - len(phi):at] if at else None, phi, theta, mean))
            at += c
        m, carries = arma.combined(parts)
        assert np.allclose(arma.profile(m, len(x), phi, theta, mean), want[:3])
        errors, at = [], 0
        for c, carry in zip(cuts, carries):
            errors.append(arma.innovations(x[at:at + c], x[at - len(phi):at] if at else None, carry, phi, theta, want[1], mean)[0])
            at += c
        assert np.allclose(np.concatenate(errors), want[3], atol=1e-6)


def test_recursion_equals_a_loop():
    rng = np.random.default_rng(1)
    for q in (1, 2, 3):
        theta, b, carry = rng.normal(0, 0.3, q), rng.normal(size=(200, 2)), rng.normal(size=(q, 2))
        past = list(carry[::-1])
        for row in b:
            past.append(row - sum(theta[j] * past[-1 - j] for j in range(q)))
        assert np.allclose(arma.recursion(b, theta, carry), past[q:])


def made(spark, series):
    return spark.createDataFrame([(k, T0 + dt.timedelta(hours=i), float(v)) for k, x in series.items() for i, v in enumerate(x)],
                                 "k string, t timestamp_ntz, y double")


def test_terms_are_recovered_and_every_row_has_an_error(spark):
    series = {"ar": simulated([0.6], [], 4000, 1, 5.0), "arma": simulated([0.5], [0.4], 4000, 2, -1.0), None: simulated([0.3], [0.2], 300, 4)}
    got = {r["k"]: r for r in fc.arima_fit(made(spark, series), "t", "y", ["k"], (1, 0, 1), train_share=0.75).collect()}
    for k, phi, theta in (("ar", 0.6, 0.0), ("arma", 0.5, 0.4)):
        r = got[k]
        assert r["n"] == 4000 and r["n_train"] == r["n_fitted"] == 3000
        assert abs(r["ar"][0] - phi) < 0.08 and abs(r["ma"][0] - theta) < 0.08
        x = series[k][:3000]
        mu = r["const"] / (1 - r["ar"][0])
        v, _ = arma.innovations(x, None, np.zeros((1, 4)), np.array(r["ar"]), np.array(r["ma"]), mu, True)
        assert r["rmse"] == pytest.approx(np.sqrt((v ** 2).mean())) and r["mae"] == pytest.approx(np.abs(v).mean())
    # no other point near the found one is likelier
    x = series["arma"][:3000]
    r = got["arma"]

    def value(a, b):
        a, b = np.array([a]), np.array([b])
        return arma.profile(arma.combined([arma.summary(x, None, a, b, True)])[0], len(x), a, b, True)[0]
    best = value(r["ar"][0], r["ma"][0])
    assert all(value(r["ar"][0] + i, r["ma"][0] + j) >= best - 1e-9 for i in (-0.01, 0, 0.01) for j in (-0.01, 0, 0.01))


@pytest.mark.parametrize("order", [(1, 0, 1), (1, 1, 0)])
def test_series_of_many_blocks_are_fitted_as_one_of_one_block(spark, monkeypatch, order):
    p, d, q = order
    series = {k: np.cumsum(x) if d else x for k, x in (("a", simulated([0.4], [0.3], 700, 5, 2.0)), ("b", simulated([0.4], [0.3], 650, 6)))}
    series["short"] = series["b"][:90]
    df = made(spark, series)
    whole = {r["k"]: r for r in fc.arima_models(df, "t", "y", ["k"], order).collect()}
    fit = {r["k"]: r for r in fc.arima_fit(df, "t", "y", ["k"], order).collect()} if d else {}
    monkeypatch.setattr(fc, "BLOCK_ROWS", 100)
    parts = {r["k"]: r for r in fc.arima_models(df, "t", "y", ["k"], order).collect()}
    fit_parts = {r["k"]: r for r in fc.arima_fit(df, "t", "y", ["k"], order).collect()} if d else {}
    assert set(whole) == set(parts) == set(series)
    for a, b in [(whole[k], parts[k]) for k in series] + [(fit[k], fit_parts[k]) for k in fit]:
        for c in a.asDict():
            same = np.allclose(a[c] or 0, b[c] or 0, atol=2e-4, rtol=2e-4) if c not in ("k", "step", "order") else a[c] == b[c]
            assert same, (a["k"], c, a[c], b[c])


def test_stored_models_forecast_as_the_direct_ones(spark, tmp_path):
    df = made(spark, {"a": simulated([0.6], [], 300, 7, 3.0), "b": simulated([0.2], [0.5], 200, 8), "tiny": [1.0]})
    path = str(tmp_path / "models")
    models = fc.arima_models(df, "t", "y", ["k"], (1, 0, 1))
    fc.save_models(models, path)
    direct = sorted(tuple(r) for r in fc.arima_forecast(df, "t", "y", ["k"], (1, 0, 1), horizon=5).collect())
    loaded = sorted(tuple(r) for r in fc.forecast(fc.load_models(spark, path), 5).collect())
    assert direct == loaded and len(direct) == 15
    assert {r[3] for r in direct if r[0] == "tiny"} == {1.0}  # too short for any term: its mean
    first = next(r for r in direct if r[0] == "a" and r[1] == 1)
    assert first[2] == T0 + dt.timedelta(hours=300)


def test_one_series_without_keys_and_empty(spark):
    df = made(spark, {"a": simulated([0.6], [], 100, 9)})
    r = fc.arima_fit(df, "t", "y", [], (1, 1, 0)).first()
    assert r["n"] == 100 and r["n_fitted"] == 80 and r["const"] is None
    assert fc.arima_fit(df.limit(0), "t", "y", ["k"], (1, 0, 0)).count() == 0
    assert fc.arima_forecast(df.limit(0), "t", "y", [], (1, 0, 0)).count() == 0


STARTS = {
    "days": pd.date_range("2024-01-30", periods=8, freq="D"), "business days": pd.bdate_range("2024-01-25", periods=12),
    "weeks": pd.date_range("2024-01-03", periods=6, freq="7D"), "month starts": pd.date_range("2023-11-01", periods=9, freq="MS"),
    "month ends": pd.date_range("2023-11-30", periods=9, freq="ME"), "quarter starts": pd.date_range("2023-01-01", periods=6, freq="QS"),
    "quarter ends": pd.date_range("2023-03-31", periods=6, freq="QE"), "years": pd.date_range("2015-01-01", periods=5, freq="YS"),
    "year ends": pd.date_range("2015-12-31", periods=5, freq="YE"), "business month ends": pd.date_range("2023-11-30", periods=9, freq="BME"),
    "business month starts": pd.date_range("2023-11-01", periods=9, freq="BMS"), "hours": pd.date_range("2024-02-28 05:30", periods=30, freq="h"),
    "mid-months at noon": pd.DatetimeIndex([pd.Timestamp(2024, m, 15, 12) for m in range(1, 9)]),
}


@pytest.mark.parametrize("name", STARTS)
def test_calendar_steps_continue_as_pandas_does(name):
    t = STARTS[name]
    us = t.astype("datetime64[us]").astype("int64").to_numpy()
    step = calendar.rule(calendar.facts(us))
    cut = len(us) // 2
    assert calendar.rule(calendar.merged([calendar.facts(us[:cut]), calendar.facts(us[cut:], int(us[cut - 1]))])) == step
    got = pd.DatetimeIndex(calendar.following(step, int(us[-1]), 14).astype("M8[us]"))
    freq = pd.infer_freq(t)
    want = pd.date_range(t[-1], periods=15, freq=freq)[1:] if freq else pd.DatetimeIndex([pd.Timestamp(2024, 8, 15, 12) + pd.DateOffset(months=i) for i in range(1, 15)])
    assert got.tolist() == want.tolist(), (step, freq)


def test_irregular_series_step_by_a_day(spark):
    us = np.array([0, 5, 7, 100], np.int64)
    assert calendar.rule(calendar.facts(us)) == f"{calendar.DAY_US}us" == calendar.rule(calendar.facts(us[:1]))
    rows = [("m", dt.datetime(2023, 1 + i, 1), float(i % 5)) for i in range(12)] + [("b", d.to_pydatetime(), float(i % 3)) for i, d in
                                                                                    enumerate(pd.bdate_range("2024-01-01", periods=30))]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, y double")
    got = {(r["k"], r["step"]): r["Date"] for r in fc.arima_forecast(df, "t", "y", ["k"], (1, 0, 0), horizon=6).collect()}
    assert [got["m", i] for i in range(1, 4)] == [dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)]
    assert all(got["b", i].weekday() < 5 for i in range(1, 7))
