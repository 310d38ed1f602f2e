import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from framewise.streaming import live_kpi as lk


def test_late_row_dropped_after_watermark(spark):
    base = tempfile.mkdtemp()
    src = f"{base}/src"
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    batches = [
        [(t0, 1.0)],
        [(t0 + dt.timedelta(hours=3), 2.0)],          # moves the watermark past 12:xx
        [(t0 + dt.timedelta(hours=3, minutes=5), 3.0)],
        [(t0 + dt.timedelta(minutes=1), 100.0)],       # late for the 12:00 window
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "t timestamp_ntz, v double").write.parquet(f"{src}/b{i}")
    stream = spark.readStream.schema("t timestamp_ntz, v double").option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).parquet(src)
    agg = lk.live_kpi(stream, "t", "v", "1 hour", "10 minutes")
    out, _ = lk.run_live_kpi(agg)
    res = {r["window_start"]: (r["events"], r["max_value"]) for r in lk.latest_windows(spark, out).collect()}
    assert res[dt.datetime(2024, 1, 1, 12)] == (1, 1.0)
    assert res[dt.datetime(2024, 1, 1, 15)] == (2, 3.0)


def test_stream_equals_batch(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    stream = lk.file_stream(spark, sf, ev.schema, glob="events.parquet")
    out, _ = lk.run_live_kpi(lk.live_kpi(stream, "ts", "value", "1 day", "1 hour"))
    got = {r["window_start"]: r["events"] for r in lk.latest_windows(spark, out).collect()}
    exp = {r[0]: r[1] for r in ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz")).count().collect()}
    assert got == exp


def test_open_windows_are_emitted(spark):
    """An append stream that ends leaves out no window; rows exactly one gap apart are one session."""
    base = tempfile.mkdtemp()
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [(1, "a", t0, 1.0), (1, "a", t0 + dt.timedelta(minutes=30), 3.0), (2, None, t0 + dt.timedelta(hours=5), 4.0),
            (2, None, t0 + dt.timedelta(hours=5, minutes=10), None), (3, "c", t0 + dt.timedelta(hours=5), None)]
    schema = "user long, `the key` string, t timestamp_ntz, v double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/src")
    want = {"session": [(1, "a", t0, dt.timedelta(hours=1), 2.0, 3.0, 1.0, 2),
                        (2, None, rows[2][2], dt.timedelta(minutes=40), 4.0, 4.0, 4.0, 2),
                        (3, "c", rows[4][2], dt.timedelta(minutes=30), None, None, None, 1)],
            "tumbling": [(1, "a", t0, dt.timedelta(hours=1), 2.0, 3.0, 1.0, 2),
                         (2, None, rows[2][2], dt.timedelta(hours=1), 4.0, 4.0, 4.0, 2),
                         (3, "c", rows[4][2], dt.timedelta(hours=1), None, None, None, 1)]}
    for kind in want:
        agg = lk.live_kpi(lk.file_stream(spark, f"{base}/src", schema), "t", "v", "1 hour", "1 hour",
                          keys=["user", "the key"], kind=kind, gap="30 minutes")
        out, _ = lk.run_live_kpi(agg, mode="append")
        got = [(r[2], r[3], r[0], r[1] - r[0], *r[4:8]) for r in spark.read.parquet(out).collect()]
        assert sorted(got, key=str) == sorted(want[kind], key=str)


def test_table_holds_each_window_once_and_a_restart_goes_on(spark, tmp_path):
    schema = "t timestamp, v double, k string"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = lk.file_stream(spark, src, schema, files_per_batch=1)
        return lk.run_live_kpi(lk.live_kpi(stream, "t", "v", "1 hour", "3 days", keys=["k"]), out, state_path=state)

    day = dt.datetime(2024, 1, 1)
    for h in range(4):
        arrive([(day + dt.timedelta(hours=h // 2, minutes=h), float(h), "a"), (day + dt.timedelta(hours=20 + h), 1.0, None)])
    run()
    # a second run reads the state and only the new file; windows of both days change
    arrive([(day + dt.timedelta(minutes=59), 10.0, "a"), (day + dt.timedelta(hours=30), 2.0, "b")])
    run()
    want = {}
    for r in spark.read.parquet(src).collect():
        w = want.setdefault((r["t"].replace(minute=0), r["k"]), [0, 0.0])
        want[r["t"].replace(minute=0), r["k"]] = [w[0] + 1, max(w[1], r["v"])]
    got = lk.latest_windows(spark, out)
    assert {(r["window_start"], r["k"]): [r["events"], r["max_value"]] for r in got.collect()} == want
    assert got.count() == len(want)
    # the same batch once more, as after a failure
    lk.upsert_windows(got.where("k = 'a'"), out, 7)
    again = lk.latest_windows(spark, out).collect()
    assert len(again) == len(want) and {(r["window_start"], r["k"]): [r["events"], r["max_value"]] for r in again} == want


@pytest.mark.parametrize("mode, kind", [("update", "tumbling"), ("append", "session")])
def test_stream_without_rows(spark, tmp_path, mode, kind):
    src = str(tmp_path / "none")
    spark.createDataFrame([], "t timestamp, v double, k string").write.parquet(src)
    agg = lk.live_kpi(lk.file_stream(spark, src, "t timestamp, v double, k string"), "t", "v", kind=kind, keys=["k"])
    out, _ = lk.run_live_kpi(agg, mode=mode)
    got = lk.latest_windows(spark, out)
    assert got.count() == 0 and got.columns == agg.columns
