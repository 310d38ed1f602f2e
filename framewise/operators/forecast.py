"""ARIMA(p, d, q) for many series at once, by exact maximum likelihood.

Every series key is fitted at once and no series has to fit in one task:

* the (optionally period-averaged) rows of a key are numbered in time order by ranges (:mod:`framewise.plans.ordered`) and
  cut into blocks of ``BLOCK_ROWS``, each with the few values before it;
* a key of one block is fitted in one task. The blocks of longer series are summed up in parallel for all points that the
  search asks about (:mod:`framewise.functions.arma`: the likelihood needs only cross products, and a block's are found
  without knowing what comes before), then put together per key; the driver holds one search per such key, a few numbers;
* every training row has a one-step prediction, the first ones from the stationary distribution (with d differences, the
  first row's is 0 and the next d - 1 continue the lower differences), so RMSE and MAE are over all of them;
* a fitted model is a table with one row per key - terms, last values and innovations, calendar step - that can be stored,
  loaded and forecast from without the series (:func:`save_models`, :func:`load_models`, :func:`forecast`).

``method="least_squares"`` (q = 0) fits the AR terms by normal equations, one grouped aggregate per key; its first p + d rows
have no prediction. Training rows are the first ``train_share`` of each series in time order; forecasts refit on every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions import arma, calendar
from framewise.functions.columns import join_small, q
from framewise.functions.distributions import normal_ppf
from framewise.plans.ordered import BUCKET, local_window, row_index, with_halo
from framewise.session import cut_lineage


def series(df: DataFrame, time: str, value: str, keys: Sequence[str] = (), every: str | None = None) -> DataFrame:
    """Series rows (keys..., t, y): null times/targets dropped; with ``every``
    the values are averaged per period first (G7)."""
    keys = list(keys)
    t = q(time).cast("timestamp_ntz")
    base = df.select(*[q(k).alias(k) for k in keys], t.alias("t"), q(value).cast("double").alias("y"))
    base = base.where(F.col("t").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y"))
    if every:
        base = (base.groupBy(*keys, F.date_trunc(every, "t").cast("timestamp_ntz").alias("t"))
                .agg(F.avg("y").alias("y")))
    return base


def _binom(d: int, k: int) -> int:
    return math.comb(d, k)


def _design(s: DataFrame, keys: list[str], p: int, d: int, train_share: float | None) -> DataFrame:
    """Rows with y, z (d-th difference), z lags 1..p, the y lags needed to undo
    differencing, and a ``train`` flag."""
    m = p + d
    idx = row_index(s, ["t"], keys, "_i")
    counts = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    idx = idx.join(counts, keys) if keys else idx.withColumn("_n", F.lit(s.count()))
    h = with_halo(idx, ["t"], keys, m, values=["y"])
    w = local_window(keys, ["t"])
    lags = {f"_y{i}": F.lag("y", i).over(w) for i in range(1, m + 1)}
    h = h.withColumns(lags).where(~F.col("_halo")).drop("_halo", BUCKET)
    ycol = {0: F.col("y"), **{i: F.col(f"_y{i}") for i in range(1, m + 1)}}

    def z_at(j: int):  # d-th difference at lag j: sum_k (-1)^k C(d,k) y_{t-j-k}
        out = None
        for k in range(d + 1):
            term = ycol[j + k] * F.lit(float((-1) ** k * _binom(d, k)))
            out = term if out is None else out + term
        return out

    h = h.withColumn("_z", z_at(0)).withColumns({f"_z{j}": z_at(j) for j in range(1, p + 1)})
    if train_share is None:
        return h.withColumn("_train", F.lit(True))
    return h.withColumn("_train", F.col("_i") < F.floor(F.col("_n") * F.lit(train_share)))


def _solve_group(pdf: pd.DataFrame, keys: list[str], names: list[str]) -> pd.DataFrame:
    """Solve one key's normal equations from its row of sums."""
    k = len(names)
    rows = []
    for _, r in pdf.iterrows():
        xtx = np.array([[r[f"s_{i}_{j}"] for j in range(k)] for i in range(k)], dtype=float)
        xty = np.array([r[f"s_{i}_y"] for i in range(k)], dtype=float)
        beta = np.linalg.lstsq(xtx, xty, rcond=None)[0] if r["_m"] > 0 else np.full(k, np.nan)
        rows.append({**{c: r[c] for c in keys}, **{f"b_{n}": float(b) for n, b in zip(names, beta)},
                     "n_fit_rows": int(r["_m"])})
    return pd.DataFrame(rows, columns=keys + [f"b_{n}" for n in names] + ["n_fit_rows"])


def _coefficients(h: DataFrame, keys: list[str], p: int, d: int, use: str) -> DataFrame:
    names = (["const"] if d == 0 else []) + [f"ar{j}" for j in range(1, p + 1)]
    xs = {"const": F.lit(1.0), **{f"ar{j}": F.col(f"_z{j}") for j in range(1, p + 1)}}
    ok = F.col(use) & F.col("_z").isNotNull()
    for j in range(1, p + 1):
        ok = ok & F.col(f"_z{j}").isNotNull()
    rows = h.where(ok)
    aggs = [F.count(F.lit(1)).alias("_m")]
    for i, a in enumerate(names):
        aggs.append(F.sum(xs[a] * F.col("_z")).alias(f"s_{i}_y"))
        for j, b in enumerate(names):
            aggs.append(F.sum(xs[a] * xs[b]).alias(f"s_{i}_{j}"))
    sums = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    key_fields = ", ".join(f"`{k}` {h.schema[k].dataType.simpleString()}" for k in keys)
    schema = ((key_fields + ", ") if keys else "") + ", ".join(f"b_{n} double" for n in names) + ", n_fit_rows long"
    if not keys:
        sums = sums.withColumn("_g", F.lit(0))
        out = sums.groupBy("_g").applyInPandas(lambda pdf: _solve_group(pdf, [], names), schema)
        return out
    return sums.groupBy(*keys).applyInPandas(lambda pdf: _solve_group(pdf, keys, names), schema)


def _attach(h: DataFrame, coef: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return join_small(h, coef, keys)
    # a single series: its one row of coefficients becomes literals
    row = coef.first()
    return h.withColumns({c: F.lit(v) for c, v in row.asDict().items()})


def _fitted(h: DataFrame, p: int, d: int) -> DataFrame:
    zhat = F.col("b_const") if d == 0 else F.lit(0.0)
    for j in range(1, p + 1):
        zhat = zhat + F.col(f"b_ar{j}") * F.col(f"_z{j}")
    undo = F.lit(0.0)
    for k in range(1, d + 1):
        undo = undo - F.lit(float((-1) ** k * _binom(d, k))) * F.col(f"_y{k}")
    return h.withColumn("_zhat", zhat).withColumn("fitted", F.col("_zhat") + undo)


def _least_squares(s: DataFrame, keys: list[str], p: int, d: int, train_share: float) -> DataFrame:
    # the design table feeds the coefficient, fit and metric jobs: build it once
    h = cut_lineage(_design(s, keys, p, d, train_share))
    fit = _fitted(_attach(h, _coefficients(h, keys, p, d, "_train"), keys), p, d)
    err, res = F.col("y") - F.col("fitted"), F.col("_z") - F.col("_zhat")
    ar = F.array(*[F.first(f"b_ar{j}") for j in range(1, p + 1)]) if p else F.array().cast("array<double>")
    return fit.where(F.col("_train")).groupBy(*keys).agg(
        F.max("_n").alias("n"), F.count(F.lit(1)).alias("n_train"), F.count("fitted").alias("n_fitted"),
        (F.first("b_const") if d == 0 else F.lit(None).cast("double")).alias("const"), ar.alias("ar"),
        F.array().cast("array<double>").alias("ma"), F.avg(res * res).alias("sigma2"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"))


# ------------------------------------------------------------------ exact likelihood
BLOCK_ROWS = 1_000_000
MODEL = ("n long, n_train long, n_fitted long, const double, ar array<double>, ma array<double>, sigma2 double, loglik double, "
         "rmse double, mae double, last_values array<double>, last_innovations array<double>, last_time long, step string")
MODEL_NAMES = [c.split()[0] for c in MODEL.split(", ")]


def _blocks(s: DataFrame, keys: list[str], m: int) -> DataFrame:
    """``(keys..., _b, total, y, t, before, t_before)``: a row per ``BLOCK_ROWS`` rows of a series, times in microseconds, with
    the ``m`` values and the time before it."""
    idx = row_index(s, ["t", "y"], keys, "_i")
    rows = idx.groupBy(*[q(k) for k in keys], F.floor(F.col("_i") / BLOCK_ROWS).cast("int").alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("_i", "y", F.unix_micros(F.col("t").cast("timestamp")).alias("t")))).alias("_r"))
    w = Window.partitionBy(*[q(k) for k in keys], F.lit(0))
    along = w.orderBy("_b")
    return cut_lineage(rows.select(
        *[q(k) for k in keys], "_b", F.sum(F.size("_r").cast("long")).over(w).alias("total"), F.col("_r.y").alias("y"), F.col("_r.t").alias("t"),
        F.lag(F.slice(F.col("_r.y"), F.lit(-max(m, 1)), F.lit(max(m, 1)))).over(along).alias("before"),
        F.lag(F.element_at("_r.t", -1)).over(along).alias("t_before")))


def _differenced(y: np.ndarray, before: np.ndarray | None, p: int, d: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The d-th differences of a block and the p before it."""
    if before is None:
        return np.diff(y, d), None
    z = np.diff(np.concatenate([before[len(before) - p - d:], y]), d)
    return z[p:], z[:p]


def _head_errors(y: np.ndarray, d: int) -> np.ndarray:
    """Prediction errors of the first d rows: the i-th is predicted by a zero i-th difference."""
    return np.array([np.diff(y[:i + 1], i)[-1] for i in range(min(d, len(y)))])


def _train_rows(total: int, share: float | None) -> int:
    return total if share is None else math.floor(total * share)


def _search(x: np.ndarray, p: int, q: int, mean: bool) -> tuple[np.ndarray, np.ndarray]:
    search = arma.minimise(arma.start(x, p, q))
    points = next(search)
    try:
        while True:
            values = []
            for u in points:
                phi, theta = arma.split(u, p)
                values.append(arma.profile(arma.combined([arma.summary(x, None, phi, theta, mean)])[0], len(x), phi, theta, mean)[0])
            points = search.send(values)
    except StopIteration as end:
        return arma.split(end.value, p)


def _model_row(phi, theta, value, mu, sigma2, d, total, n_train, n, sse, sae, last_y, last_e, last_t, step) -> list:
    ok = n > 0 and n_train > 0
    loglik = -0.5 * n * (value + 1 + math.log(2 * math.pi)) if ok else None
    const = float(mu * (1 - phi.sum())) if ok and d == 0 else None
    return [total, n_train, n_train, const, phi.tolist() if ok else None, theta.tolist() if ok else None, float(sigma2) if ok else None, loglik,
            math.sqrt(sse / n_train) if ok else None, sae / n_train if ok else None, last_y, last_e, last_t, step]


def _fit_whole(pdf: pd.DataFrame, keys: list[str], order, share: float | None) -> pd.DataFrame:
    """The model of a series of one block."""
    (p, d, q_), r = order, pdf.iloc[0]
    y, t = np.asarray(r["y"], float), np.asarray(r["t"], np.int64)
    n_train = _train_rows(len(y), share)
    used, x, mean = y[:n_train], np.diff(y[:n_train], d), d == 0
    phi, theta = _search(x, p, q_, mean) if len(x) > p + q_ + 1 else (np.zeros(p), np.zeros(q_))
    m, (carry,) = arma.combined([arma.summary(x, None, phi, theta, mean)])
    value, mu, sigma2 = arma.profile(m, len(x), phi, theta, mean)
    v, last_e = arma.innovations(x, None, carry, phi, theta, mu, mean)
    errors = np.concatenate([_head_errors(used, d), v])
    row = _model_row(phi, theta, value, mu, sigma2, d, len(y), n_train, len(x), float(errors @ errors), float(np.abs(errors).sum()),
                     used[max(0, n_train - max(p + d, 1)):].tolist(), last_e[::-1].tolist(), int(t[-1]), calendar.rule(calendar.facts(t)))
    return pd.DataFrame([[*(r[k] for k in keys), *row]], columns=keys + MODEL_NAMES)


def _fit_long(hot: DataFrame, keys: list[str], order, share: float | None) -> DataFrame:
    """The models of series of several blocks. There are at most as many as ``BLOCK_ROWS`` goes into the number of rows; the
    driver has each one's search, terms and error sums."""
    (p, d, q_), mean = order, order[1] == 0
    spark = hot.sparkSession
    series = hot.where("_b = 0").select(*[q(k) for k in keys], "total").collect()
    names = spark.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(series)],
                                  T.StructType([hot.schema[k] for k in keys] + [T.StructField("_h", T.IntegerType())]))
    on = [hot[k].eqNullSafe(names[k]) for k in keys]
    rows = cut_lineage(hot.join(F.broadcast(names), on).select("_h", *[hot[c] for c in hot.columns if c not in keys]))
    n_train = [_train_rows(r["total"], share) for r in series]

    def part(r) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """A block's training values, their differences, and the differences before them."""
        y = np.asarray(r["y"], float)[:max(0, n_train[r["_h"]] - r["_b"] * BLOCK_ROWS)]
        return y, *_differenced(y, None if r["_b"] == 0 else np.asarray(r["before"], float), p, d)

    def summed(points: dict[int, list[np.ndarray]]) -> dict[int, list]:
        """Per series and point: the likelihood's value, mean and variance, and what each block is carried."""
        terms = {h: [arma.split(u, p) for u in us] for h, us in points.items()}

        def run(batches):
            for b in batches:
                out = []
                for _, r in b.iterrows():
                    _, x, before = part(r)
                    for k, (phi, theta) in enumerate(terms.get(r["_h"], [])):
                        flat = [a.ravel() for a in arma.summary(x, before, phi, theta, mean)] if len(x) else []
                        out.append((r["_h"], k, r["_b"], len(x), np.concatenate(flat).tolist() if flat else []))
                yield pd.DataFrame(out, columns=["_h", "k", "_b", "n", "m"])

        def together(g: pd.DataFrame) -> pd.DataFrame:
            g = g[g["n"] > 0].sort_values("_b")
            phi, theta = terms[int(g["_h"].iloc[0])][int(g["k"].iloc[0])]
            c = (2 if mean else 1) + p + q_
            shapes = [(c, c), (c, q_), (q_, q_), (q_, c), (q_, q_)]
            cuts = np.cumsum([a * b for a, b in shapes])[:-1]
            blocks = [tuple(a.reshape(s) for a, s in zip(np.split(np.asarray(m, float), cuts), shapes)) for m in g["m"]]
            m, carries = arma.combined(blocks)
            value, mu, sigma2 = arma.profile(m, int(g["n"].sum()), phi, theta, mean)
            return pd.DataFrame([(g["_h"].iloc[0], g["k"].iloc[0], value, mu, sigma2, int(g["n"].sum()), np.concatenate(carries).ravel().tolist())],
                                columns=["_h", "k", "value", "mu", "sigma2", "n", "carries"])

        sums = rows.mapInPandas(run, "_h int, k int, _b int, n long, m array<double>").groupBy("_h", "k").applyInPandas(
            together, "_h int, k int, value double, mu double, sigma2 double, n long, carries array<double>")
        found = {h: [None] * len(us) for h, us in points.items()}
        for r in sums.collect():
            found[r["_h"]][r["k"]] = r
        return found

    # start values from each series' first block
    begun = {r["_h"]: arma.start(np.asarray(r["u"], float), p, q_) for r in rows.where("_b = 0").select(
        "_h", F.slice("y", 1, 50_000 + d).alias("u")).toPandas().assign(u=lambda f: [np.diff(np.asarray(y, float), d) for y in f["u"]]).to_dict("records")}
    searches = {h: arma.minimise(u) for h, u in begun.items()}
    best, points = {}, {h: next(g) for h, g in searches.items()}
    while points:
        values, points = summed(points), {}
        for h, rs in values.items():
            try:
                points[h] = searches[h].send([r["value"] for r in rs])
            except StopIteration as end:
                best[h] = end.value
    last = {h: rs[0] for h, rs in summed({h: [u] for h, u in best.items()}).items()}
    terms = {h: arma.split(u, p) for h, u in best.items()}
    known = {h: (r["mu"], np.asarray(r["carries"], float).reshape(-1, q_, (2 if mean else 1) + p + q_) if q_ else None) for h, r in last.items()}

    def errors(batches):
        for b in batches:
            out = []
            for _, r in b.iterrows():
                h, t = int(r["_h"]), np.asarray(r["t"], np.int64)
                y, x, before = part(r)
                head, v, tail = np.zeros(0), np.zeros(0), np.zeros(0)
                if len(x):
                    mu, carries = known[h]
                    carry = carries[int(r["_b"])] if q_ else np.zeros((0, 0))
                    v, tail = arma.innovations(x, before, carry, *terms[h], mu, mean)
                    head = _head_errors(y, d) if r["_b"] == 0 else head
                e = np.concatenate([head, v])
                have = np.concatenate([[] if r["_b"] == 0 else np.asarray(r["before"], float), y])[-max(p + d, 1):]
                prev = r["t_before"]
                out.append((h, int(r["_b"]), float(e @ e), float(np.abs(e).sum()), len(y), have.tolist(), tail[::-1].tolist(), int(t[-1]),
                            calendar.facts(t, None if pd.isna(prev) else int(prev))))
            yield pd.DataFrame(out, columns=["_h", "_b", "sse", "sae", "n", "last", "tail", "t", "facts"])

    parts = rows.mapInPandas(errors, "_h int, _b int, sse double, sae double, n long, last array<double>, tail array<double>, t long, facts array<long>")
    used = F.struct(F.col("n") > 0, "_b")
    ends = parts.groupBy("_h").agg(F.sum("sse").alias("sse"), F.sum("sae").alias("sae"), F.max("t").alias("t"), F.max_by("last", used).alias("last"),
                                   F.max_by("tail", used).alias("tail"), *[
        {"sum": F.sum, "low": F.min, "high": F.max}["sum" if f == "pairs" else "high" if f.endswith("_high") else "low"](F.col("facts")[i]).alias(f)
        for i, f in enumerate(calendar.FACTS)])
    out = []
    for r in ends.collect():
        h, l = r["_h"], last[r["_h"]]
        out.append((*[series[h][k] for k in keys], *_model_row(*terms[h], l["value"], l["mu"], l["sigma2"], d, series[h]["total"], n_train[h], l["n"], r["sse"],
                                                              r["sae"], r["last"], r["tail"], r["t"], calendar.rule([r[f] for f in calendar.FACTS]))))
    return spark.createDataFrame(out, T.StructType([hot.schema[k] for k in keys] + T._parse_datatype_string(MODEL).fields))


def _models(s: DataFrame, keys: list[str], order, share: float | None) -> DataFrame:
    blocks = _blocks(s, keys, order[0] + order[1])
    few = blocks.where(F.col("total") <= BLOCK_ROWS).withColumn("_g", F.lit(0))
    fields = "".join(f"`{k}` {s.schema[k].dataType.simpleString()}, " for k in keys)
    models = few.groupBy(*[q(k) for k in keys], "_g").applyInPandas(lambda pdf: _fit_whole(pdf, keys, order, share), fields + MODEL)
    hot = blocks.where(F.col("total") > BLOCK_ROWS)
    return models if hot.isEmpty() else models.unionByName(_fit_long(hot, keys, order, share))


def arima_fit(df: DataFrame, time: str, value: str, keys: Sequence[str] = (), order=(5, 1, 0), every: str | None = None,
              train_share: float = 0.8, method: str = "exact") -> DataFrame:
    """M18 + M19: per key the terms (``const`` only when d = 0, the intercept), innovation variance, and in-sample RMSE / MAE over
    the training rows that have a prediction (``n_fitted``: all of them; by least squares all but the first p + d)."""
    p, d, q_ = order
    keys = list(keys)
    s = series(df, time, value, keys, every)
    if method == "least_squares":
        if q_:
            raise ValueError("least squares fits AR terms only")
        found = _least_squares(s, keys, p, d, train_share)
    elif method == "exact":
        found = _models(s, keys, (p, d, q_), train_share)
    else:
        raise ValueError(f"unknown method {method!r}")
    return found.select(*[q(k) for k in keys], "n", "n_train", "n_fitted", F.lit(f"({p},{d},{q_})").alias("order"), "const", "ar", "ma",
                        "sigma2", "rmse", "mae")


def arima_models(df: DataFrame, time: str, value: str, keys: Sequence[str] = (), order=(5, 1, 0), every: str | None = None) -> DataFrame:
    """Fitted models, a row per key with all that :func:`forecast` needs; every row is used."""
    keys, order = list(keys), tuple(order)
    found = _models(series(df, time, value, keys, every), keys, order, None)
    return found.withColumn("order", F.array(*map(F.lit, order)))


def save_models(models: DataFrame, path: str) -> None:
    """A12 for forecasts: the models as a table at ``path``, replacing what is there."""
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _psi(phi: np.ndarray, d: int, h: int, theta: np.ndarray | None = None) -> np.ndarray:
    """psi-weights of (1 + theta(B)) / ((1 - phi(B)) (1 - B)^d)."""
    poly = np.concatenate([[1.0], -phi]) if len(phi) else np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    a = -poly[1:]
    psi = np.zeros(h)
    psi[0] = 1.0
    th = theta if theta is not None else np.array([])
    for j in range(1, h):
        psi[j] = (th[j - 1] if j <= len(th) else 0.0) + \
            sum(a[i - 1] * psi[j - i] for i in range(1, min(j, len(a)) + 1))
    return psi


def _forecast_rows(r, keys: list[str], horizon: int, zq: float) -> list[tuple]:
    p, d, q_ = (int(x) for x in r["order"])
    if r["ar"] is None or r["sigma2"] is None or len(r["last_values"]) < p + d:
        return []
    phi, theta = np.array(r["ar"], float), np.array(r["ma"], float)
    y, eps = [float(v) for v in r["last_values"]], [float(v) for v in r["last_innovations"]]
    c = float(r["const"]) if d == 0 else 0.0
    values = []
    for _ in range(horizon):
        arr = np.array(y)
        z = np.diff(arr, n=d) if d else arr
        zf = c + sum(phi[j - 1] * z[-j] for j in range(1, p + 1)) + sum(theta[j - 1] * eps[-j] for j in range(1, q_ + 1) if len(eps) >= j)
        eps.append(0.0)  # future innovations have mean zero
        # undo the differencing: y_t = z_t - sum_{k>=1} (-1)^k C(d,k) y_{t-k}
        y.append(zf - sum(((-1) ** k) * math.comb(d, k) * arr[-k] for k in range(1, d + 1)))
        values.append(y[-1])
    se = np.sqrt(float(r["sigma2"]) * np.cumsum(_psi(phi, d, horizon, theta) ** 2))
    times = calendar.following(r["step"], int(r["last_time"]), horizon)
    return [(*[r[k] for k in keys], i + 1, pd.Timestamp(int(t) * 1000), float(v), float(v - zq * e), float(v + zq * e))
            for i, (t, v, e) in enumerate(zip(times, values, se))]


def forecast(models: DataFrame, horizon: int = 10, level: float = 0.95) -> DataFrame:
    """M20 from fitted or loaded models: ``horizon`` future steps per key with a ``level`` interval. Times continue by the
    series' calendar step (months, quarters, years and their ends, business days, any constant gap); one day if it has none.
    A series of at most p + q + 1 differences is fitted without terms; one without any difference has no rows."""
    keys = [c for c in models.columns if c not in [*MODEL_NAMES, "order"]]
    zq = normal_ppf(0.5 + level / 2)
    names = keys + ["step", "Date", "Forecast", "Lower CI", "Upper CI"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [row for r in b.to_dict("records") for row in _forecast_rows(r, keys, horizon, zq)]
            yield pd.DataFrame(rows, columns=names)

    fields = "".join(f"`{k}` {models.schema[k].dataType.simpleString()}, " for k in keys)
    return models.mapInPandas(run, fields + "step int, Date timestamp_ntz, Forecast double, `Lower CI` double, `Upper CI` double")


def arima_forecast(df: DataFrame, time: str, value: str, keys: Sequence[str] = (), order=(5, 1, 0),
                   horizon: int = 10, every: str | None = None, level: float = 0.95) -> DataFrame:
    """:func:`arima_models` on all rows, then :func:`forecast`."""
    return forecast(arima_models(df, time, value, keys, order, every), horizon, level)
