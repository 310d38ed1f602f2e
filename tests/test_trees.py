"""Trees from cells of binned rows against Spark's learners on the same rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from framewise.operators import ml, trees


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 13_000  # more than the 10,000 rows that Spark samples for its thresholds
    a, b, c = rng.integers(0, 50, n) / 7.0 - 3.0, rng.integers(0, 6, n) * 1.0, rng.integers(0, 2, n) * 1.0
    y = 900.0 + a * a - 3.0 * b * c + rng.normal(0, 2.0, n)
    k = np.digitize(a + b + rng.normal(0, 1.5, n), [0.5, 3.5])
    rows = zip(*(v.tolist() for v in (a, b, c, y, k.astype(float))))
    df = spark.createDataFrame(list(rows), "a double, b double, c double, y double, k double").repartition(3).persist()
    assert df.count() == n
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


@pytest.fixture()
def no_spark_fit(monkeypatch):
    """Tables of any size are fitted from cells, and a call of Spark's learner fails."""
    monkeypatch.setattr(trees, "SMALL", 0)

    def block(*kinds):
        for kind in kinds:
            monkeypatch.setattr(kind, "fit", None)
    return block


def _predicted(model, table):
    return np.array([r[0] for r in model.transform(table).select("prediction").collect()])


@pytest.mark.parametrize("kind", ["gbt_reg", "gbt_clf"])
def test_boosted_trees_are_sparks(table, no_spark_fit, kind):
    label = F.col("y") if kind == "gbt_reg" else (F.col("k") > 0).cast("double")
    data = table.withColumn("label", label)
    est = ml.make_estimator(kind, maxIter=5, maxDepth=4)
    want = est.fit(data)
    no_spark_fit(type(est))
    got = trees.fit(est, data)
    assert type(got) is type(want) and got.treeWeights == want.treeWeights and got.numFeatures == 3
    assert [t.numNodes for t in got.trees] == [t.numNodes for t in want.trees]
    assert np.allclose(_predicted(got, data), _predicted(want, data), rtol=1e-9)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)


def test_one_against_rest_is_sparks(table, no_spark_fit):
    data = table.withColumn("label", F.col("k"))
    est = ml.make_estimator("gbt_clf", 3, maxIter=3, maxDepth=3)
    want = est.fit(data)
    no_spark_fit(type(est), type(est.getClassifier()))
    got = trees.fit(est, data)
    assert len(got.models) == 3 and (_predicted(got, data) == _predicted(want, data)).all()


def test_forest_is_as_good_as_sparks(table, no_spark_fit, monkeypatch):
    """The draws are others: trees differ, but not from one another only, and the forest predicts as well as Spark's."""
    data = table.withColumn("label", F.col("y"))
    est = ml.make_estimator("rf_reg", numTrees=20, maxDepth=5)
    want = est.fit(data)
    no_spark_fit(type(est))
    monkeypatch.setattr(trees, "FOREST_VALUES", 6_000)  # several passes
    got = trees.fit(est, data)
    assert got.getNumTrees == 20 and all(t.depth == 5 for t in got.trees) and len({t.toDebugString.split("\n", 1)[1] for t in got.trees}) == 20
    y = np.array([r[0] for r in data.select("label").collect()])
    a, b = _predicted(got, data), _predicted(want, data)
    assert np.mean((a - y) ** 2) == pytest.approx(np.mean((b - y) ** 2), rel=0.05)
    assert np.mean((a - b) ** 2) < 0.05 * np.mean((b - y) ** 2)
    again = trees.fit(est, data)
    assert (_predicted(again, data) == a).all()  # reruns agree


def test_forest_draws_rows_not_cells(spark, no_spark_fit):
    """A tree's count of a cell is a sum of Poisson counts of its rows: mean and variance are the cell's number of rows."""
    df = spark.createDataFrame([(float(i % 4), float(i % 3)) for i in range(4000)], "a double, label double").repartition(3)
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    got = trees.fit(ml.make_estimator("rf_reg", numTrees=200, maxDepth=1), data)
    roots = np.array([float(t._call_java("rootNode").impurityStats().count()) for t in got.trees])
    assert abs(roots.mean() - 4000) < 20 and 2800 < roots.var() < 5400


def test_many_cells_and_small_tables_go_to_spark(table, monkeypatch):
    data, est = table.withColumn("label", F.col("y")), ml.make_estimator("gbt_reg", maxIter=2, maxDepth=2)
    monkeypatch.setattr(trees, "_boosted", None)
    assert trees.fit(est, data).getNumTrees == 2  # few rows
    monkeypatch.setattr(trees, "SMALL", 0)
    monkeypatch.setattr(trees, "MAX_CELLS", 100)
    assert trees.fit(est, data).getNumTrees == 2


def test_model_from_cells_is_stored_and_scores_alike(table, no_spark_fit, tmp_path):
    b, pred = ml.train(table.drop("features"), ["a", "b", "c"], "y", "gbt_reg", maxIter=3, maxDepth=3)
    assert b.metrics["r2"] > 0.5
    ml.save_model(b, str(tmp_path / "m"))
    loaded = ml.load_model(table.sparkSession, str(tmp_path / "m"))
    x = table.drop("features").limit(50).persist()
    assert ml.score(loaded, x).collect() == ml.score(b, x).collect()
