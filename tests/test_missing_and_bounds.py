"""Missing values, ragged inputs, time zones and default bounds."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from framewise.operators import charts, clean, columns, ml, unsupervised


def test_nan_is_missing_in_features(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,), (3.0,)], "x double")
    z = [r["x"] for r in ml.standard_scale(df, ["x"]).collect()]
    assert z[2] is None and z[3] is None and abs(z[0] + 1.5 ** 0.5) < 1e-9 and abs(z[1]) < 1e-9
    got = [r["x__z"] for r in ml.prepare_features(df, ["x"]).collect()]
    assert got[2] == got[3] == 0.0 and got[0] < 0 < got[4]


def test_ragged_arrays_are_dropped(spark):
    rows = [(i, [float(i), float(i % 3), 1.0 + i * i]) for i in range(12)] + [(90, [1.0]), (91, []), (92, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    out = unsupervised.kmeans(df, k=2, n_init=1, array_col="v", keep=["id"])
    assert sorted(r["id"] for r in out.collect()) == list(range(12))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_sample_rows_of_a_tiny_share(spark):
    df = spark.range(11_000_000).withColumnRenamed("id", "x")
    n = charts.sample_rows(df, 10).count()
    assert 2 < n < 25
    assert abs(charts.sample_rows(spark.range(100_000), 5000).count() - 5000) < 500


def test_no_default_caps(spark):
    df = spark.range(1500).select(F.format_string("c%04d", "id").alias("c"), F.col("id").alias("o"), F.col("id").cast("double").alias("v"))
    assert len(columns.one_hot(df.select("c"), ["c"]).columns) == 1499
    assert charts.kpi_trend(df, "v", ["o"]).count() == 1500
    _, labels = ml.encode_target(df.where("o < 30"), "c")
    assert len(labels) == 30


def test_mode_of_instants_ignores_the_drivers_zone(spark):
    t = dt.datetime(2024, 1, 5, 10, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(t,), (t,), (None,)], "t timestamp")
    before = os.environ.get("TZ")
    try:
        os.environ["TZ"] = "America/New_York"
        time.tzset()
        out = clean.fill_mode(df).select(F.date_format("t", "yyyy-MM-dd HH:mm").alias("s")).collect()
    finally:
        os.environ.pop("TZ") if before is None else os.environ.update(TZ=before)
        time.tzset()
    assert {r["s"] for r in out} == {"2024-01-05 10:00"}


def test_modes_of_any_type_fill_in_their_own_type(spark):
    import datetime as dt
    import decimal
    schema = "i int, b binary, a array<int>, s struct<x:int,y:string>, t timestamp, n timestamp_ntz, d date, dec decimal(10,2), f float, o boolean, m map<string,int>"
    t = dt.datetime(2024, 3, 31, 2, 30, 0, 5)
    row = (1, b"\x00\xff", [1, 2], (1, "z"), t, t, dt.date(2024, 2, 29), decimal.Decimal("1.10"), 0.1, False, {"k": 1})
    other = (2, b"a", [3], (0, "a"), t, dt.datetime(2020, 1, 1), dt.date(2020, 1, 1), decimal.Decimal("9.99"), float("nan"), True, {"k": 2})
    df = spark.createDataFrame([row, row, other, (None,) * 11], schema)
    got = clean.fill_mode(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    filled = [r for r in got.collect() if r["m"] is None]
    want = df.where("i = 1").first()
    assert len(filled) == 1 and all(filled[0][c] == want[c] for c in df.columns if c != "m")
    whole = df.where("i = 1")
    assert "Aggregate" not in clean.fill_mode(whole)._jdf.queryExecution().executedPlan().toString()  # nothing is missing
