"""Samples of exact size and splits, on tables where many rows are equal."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewise.functions import sampling
from framewise.operators import charts, ml


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are one point, some are null, the rest differ."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1.5).when(F.col("id") % 100 == 1, None).otherwise(F.col("id").cast("double")).alias("x"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("other").alias("_copy"))


def test_sample_has_exactly_the_size_and_the_proportions(skewed):
    shares = []
    for seed in range(3):
        rows = charts.sample_rows(skewed, 900, seed).collect()
        assert len(rows) == 900 and rows[0].asDict().keys() == {"x", "_copy"}
        shares.append(sum(r["x"] == 1.5 for r in rows) / 900)
    assert all(0.27 < s < 0.40 for s in shares) and len(set(shares)) > 1
    again = charts.sample_rows(skewed.repartition(7), 900, 1).collect()
    assert Counter(again) == Counter(charts.sample_rows(skewed, 900, 1).collect())
    assert charts.sample_rows(skewed, 6000).count() == charts.sample_rows(skewed, 9999).count() == 6000
    assert sampling.sample(skewed, 0).count() == 0
    by_key = skewed.withColumn("key", F.monotonically_increasing_id())
    assert charts.sample_rows(by_key, 10, key=["key"]).count() == 10


def test_copies_are_numbered_and_chunked(spark, skewed, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 100)
    rows = sampling.numbered_copies(skewed, "n").collect()
    assert len(rows) == 6000 and len(set(rows)) == 6000
    assert sorted(r["n"] for r in rows if r["x"] == 1.5) == list(range(2000))
    assert Counter((r["x"], r["_copy"]) for r in rows) == Counter(map(tuple, skewed.collect()))


def test_split_of_two_distinct_rows_has_both_sides(spark, skewed):
    two = spark.range(20_000).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    train, test = ml.split(two, 0.2)
    n = test.count()
    assert train.count() + n == 20_000 and 3600 < n < 4400 and test.columns == ["x", "y"]
    assert test.select("x").distinct().count() == 2
    model, scored = ml.train(two, ["x"], "y", "linear")
    assert 3600 < scored.count() < 4400 and model.metrics["r2"] == pytest.approx(1.0)
