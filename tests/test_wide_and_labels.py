"""Correlation of many columns in one pass, and label codes without a list on the driver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.operators import charts, ml


def wide(spark, k, n=400):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) + 1e6
    x[rng.random((n, k)) < 0.1] = np.nan
    x[:, 1], x[:, 2] = 7.0, np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("k", [5, 60])
def test_correlation_of_few_and_many_columns(spark, k):
    pdf, df = wide(spark, k)
    want = pdf.corr()
    rows = charts.correlation(df).collect()
    assert len(rows) == k * k
    for r in rows:
        w = want.loc[r["x"], r["y"]]
        assert (r["corr"] is None) == bool(np.isnan(w)) and (r["corr"] is None or abs(r["corr"] - w) < 1e-9), r
    if k > charts.WIDE:
        plan = charts._gram(df.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(df.columns)]), k)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert charts.correlation(df.limit(0)).count() == 0 or all(r["corr"] is None for r in charts.correlation(df.limit(0)).collect())


def test_codes_are_dense_and_sorted(spark, monkeypatch):
    from framewise.plans import ordered
    monkeypatch.setattr(ordered, "ROWS_WORTH_A_BUCKET", 500)  # several ranges
    df = spark.range(5000).select(F.concat(F.lit("l"), F.col("id") % 1700).alias("a"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("_code"), "id")
    got = ml.label_encode(df, ["a", "_code"])
    assert got.columns == df.columns
    want = {v: i for i, v in enumerate(sorted({f"l{i}" for i in range(1700)}))}
    rows = got.collect()
    assert len(rows) == 5000
    assert all(r["a"] == want[f"l{r['id'] % 1700}"] and r["_code"] == (0 if r["id"] % 5 else None) for r in rows)


def test_unknown_and_missing_labels_are_scored_as_the_mode(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 1.5), ("y", 9.0), ("x", 1.2), ("y", 8.0)] * 20, "c string, t double")
    bundle, _ = ml.train(df, ["c"], "t", "linear")
    out = {r["c"]: r["prediction"] for r in ml.score(bundle, spark.createDataFrame([("x",), ("zz",), (None,), ("y",)], "c string").withColumn("k", F.lit(1))).collect()}
    assert out["x"] == pytest.approx(1.25, abs=0.2) and out["y"] == pytest.approx(8.5, abs=0.3)
    assert len(out) <= 3 and all(v in (out["x"], out["y"]) for v in out.values())
