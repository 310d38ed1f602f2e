"""Date texts of many shapes, and JSON schemas by an aggregate of variants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from framewise.sources import nested, schema

DAY = dt.datetime(2020, 1, 5)


@pytest.mark.parametrize("text, want", [
    ("1/5/2020", DAY), ("01/05/2020", DAY), ("Jan 5, 2020", DAY), ("January 5, 2020", DAY), ("jan 5 2020", DAY), ("20200105", DAY),
    ("5 Jan 2020", DAY), ("5-January-2020", DAY), ("Sun, 5 Jan 2020", DAY), ("2020-01-05", DAY), ("2020/1/5", DAY), ("2020-01", dt.datetime(2020, 1, 1)),
    ("Jan 2020", dt.datetime(2020, 1, 1)), (" 2020-01-05T10:30:00 ", dt.datetime(2020, 1, 5, 10, 30)), ("1/5/2020 9:05", dt.datetime(2020, 1, 5, 9, 5)),
    ("1/5/2020 9:05 PM", dt.datetime(2020, 1, 5, 21, 5)), ("1/5/2020 9:05pm", dt.datetime(2020, 1, 5, 21, 5)), ("20200105093001", dt.datetime(2020, 1, 5, 9, 30, 1)),
    ("25.12.2020", dt.datetime(2020, 12, 25)), ("25/12/2020 08:00:01", dt.datetime(2020, 12, 25, 8, 0, 1)), ("may 7 2021", dt.datetime(2021, 5, 7))])
def test_shapes(spark, text, want):
    df = spark.createDataFrame([(text,), (text,), ("junk",)], "x string")
    assert schema.convert_datetimes(df).collect()[0]["x"] == want


@pytest.mark.parametrize("text", ["12345678", "abc 5 2020", "1/5", "13/13/2020", "2020", "5", "", "Jan 32, 2020", "lorem ipsum 2020-01-05"])
def test_other_texts_stay(spark, text):
    df = spark.createDataFrame([(text,), (text,)], "x string")
    assert schema.convert_datetimes(df).collect()[0]["x"] == text


def test_one_column_of_many_shapes_and_orders(spark):
    rows = [("1/5/2020", "05.01.2020"), ("Jan 5, 2020", "25.01.2020"), ("20200105", "06.01.2020"), ("n/a", "7.1.2020"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    out = schema.convert_datetimes(df).collect()
    assert [r["a"] for r in out] == [DAY] * 3 + [None] * 2
    # the 25th tells that days come first, for the whole column
    assert [r["b"] and (r["b"].day, r["b"].month) for r in out] == [(5, 1), (25, 1), (6, 1), (7, 1), None]
    kinds = {r["column"]: r["kind"] for r in schema.column_types(df.withColumn("c", F.lit("text"))).collect()}
    assert kinds == {"a": "datetime", "b": "datetime", "c": "categorical"}
    assert schema.convert_datetimes(df, threshold=0.7).dtypes[0] == ("a", "string")
    assert schema.convert_datetimes(df.limit(0)).dtypes == df.dtypes


def test_json_schema_without_python(spark):
    texts = ['{"a": 1, "b": {"c": "x", "d": [1, 2]}}', '{"a": 2.5, "e": true, "b": {"f": null}}', '{"g h": [{"i": 1}, {"j": "k"}], "a": 3}', "not json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, p string")
    out = nested.flatten_json_col(df, "p")
    assert out.columns == ["id", "p.a", "p.b.c", "p.b.d", "p.b.f", "p.e", "p.g h"]
    rows = {r["id"]: r for r in out.collect()}
    assert [rows[i]["p.a"] for i in range(5)] == [1.0, 2.5, 3.0, None, None]
    assert rows[0]["p.b.c"] == "x" and rows[0]["p.b.d"] == [1, 2] and rows[1]["p.e"] is True
    assert [tuple(x) for x in rows[2]["p.g h"]] == [(1, None), (None, "k")]
    plan = df.agg(F.schema_of_variant_agg(F.try_parse_json("p")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert nested.flatten_json_col(df.limit(0), "p").dtypes == df.dtypes
    numbers = nested.flatten_json_col(spark.createDataFrame([('{"n": 1}',), ('{"n": "t"}',), ('{"n": 123456789012345}',)], "p string"), "p")
    assert [r["p.n"] for r in numbers.collect()] == ["1", "t", "123456789012345"]
