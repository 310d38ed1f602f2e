import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import ml, unsupervised as un


def test_split_disjoint_complete(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    tr, te = ml.split(o, 0.2, 42, ["o_orderkey"])
    a = {r[0] for r in tr.select("o_orderkey").collect()}
    b = {r[0] for r in te.select("o_orderkey").collect()}
    assert not (a & b) and len(a | b) == o.count()
    assert 0.15 < len(b) / o.count() < 0.25
    with pytest.raises(ValueError):
        ml.split(o, 0.7)


def test_pca_orthonormal_matches_numpy(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    load = un.pca_loadings(li, cols, k=2).toPandas()
    w = load[["PC1", "PC2"]].to_numpy()
    assert np.allclose(w.T @ w, np.eye(2), atol=1e-8)
    x = li.select(*cols).toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    vals, vecs = np.linalg.eigh(np.cov(z, rowvar=False))
    top = vecs[:, np.argsort(vals)[::-1][:2]]
    for j in range(2):
        assert abs(abs(float(top[:, j] @ w[:, j])) - 1) < 1e-6
    var = un.pca_variance(li, cols, k=2).toPandas()
    assert np.allclose(var.explained_variance_ratio, np.sort(vals)[::-1][:2] / vals.sum(), atol=1e-8)


def test_elbow_non_increasing(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    inertia = [r["inertia"] for r in un.elbow(e, array_col="embedding", max_k=5).orderBy("k").collect()]
    assert len(inertia) == 5
    assert all(b <= a + 1e-6 for a, b in zip(inertia, inertia[1:]))


def test_kmeans_counts_sum(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    a = un.kmeans(li, ["l_quantity", "l_extendedprice"], k=3, n_init=2)
    assert sum(r["count"] for r in un.cluster_counts(a).collect()) == li.count()


def test_save_load_scores_unchanged_and_unseen(spark, sf, tmp_path):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    b, _ = ml.train(o, ["o_totalprice", "o_orderpriority"], "o_orderstatus", "logistic")
    before = ml.score(b, o).select("o_orderkey", "prediction")
    ml.save_model(b, str(tmp_path / "m"))
    b2 = ml.load_model(spark, str(tmp_path / "m"))
    after = ml.score(b2, o).select("o_orderkey", F.col("prediction").alias("p2"))
    assert before.join(after, "o_orderkey").where(F.col("prediction") != F.col("p2")).count() == 0
    unseen = spark.createDataFrame([(1.0, "NEVER-SEEN")], "o_totalprice double, o_orderpriority string")
    mode = b2.info["modes"]["o_orderpriority"]
    seen = spark.createDataFrame([(1.0, mode)], "o_totalprice double, o_orderpriority string")
    assert ml.score(b2, unseen).first()["prediction"] == ml.score(b2, seen).first()["prediction"]


def test_target_refusals(spark):
    df = spark.createDataFrame([(float(i), str(i)) for i in range(30)], "x double, y string")
    with pytest.raises(ValueError):
        ml.encode_target(df, "y", max_classes=20)
    with pytest.raises(ValueError):
        ml.encode_target(df.withColumn("y", F.lit("a")), "y")


def test_linear_regression_exact(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x + 2.0) for x in range(20)], "x double, y double")
    coef = {r["term"]: r["coefficient"] for r in ml.linear_coefficients(df, ["x"], "y").collect()}
    assert coef["x"] == pytest.approx(3.0) and coef["intercept"] == pytest.approx(2.0)


def test_elbow_takes_ten_starts(spark, monkeypatch):
    e = spark.createDataFrame([(float(i % 5), float(i % 3)) for i in range(12)], "x double, y double").coalesce(1)
    made, real = [], un.KMeans
    monkeypatch.setattr(un, "KMeans", lambda **kw: made.append(kw) or real(**kw))
    inertia = [r["inertia"] for r in un.elbow(e, ["x", "y"], max_k=2).orderBy("k").collect()]
    assert len(inertia) == 2 and len({m["seed"] for m in made}) == 10
    assert all(m["maxIter"] == 300 for m in made)


def test_registered_models_run_the_full_job(spark, sf, monkeypatch):
    """Registered fits leave rounds, grid and starts at the operators' defaults."""
    from framewise.plans import catalog
    seen = []

    class Stop(Exception):
        pass

    def spy(*args, **kw):
        seen.append(kw)
        raise Stop

    for module, names in ((catalog.ml, ["train"]), (catalog.un, ["kmeans", "kmeans_fit", "elbow"])):
        for n in names:
            monkeypatch.setattr(module, n, spy)
    queries = ["model_gbt_reg", "model_gbt_clf", "model_gbt_multiclass", "model_tuned_rf", "kmeans_embeddings",
               "cluster_counts", "centroids", "elbow"]
    for name in queries:
        try:
            catalog.QUERIES[name](spark, sf)
        except Stop:
            pass
    assert len(seen) == len(queries)
    assert not any(k in kw for kw in seen for k in ("maxIter", "grid", "n_init", "max_iter", "numTrees", "maxDepth"))


@pytest.fixture()
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1.0, (40, 3)) for c in (0.0, 4.0, 9.0)]).tolist()
    return un._scaled_vectors(spark.createDataFrame([(*p,) for p in x + x[:7]], "x double, y double, z double").coalesce(2),
                              ["x", "y", "z"], None)


def test_shared_passes_end_where_sparks_kmeans_ends(spark, points):
    vec, dim = points
    starts = [e for k in (2, 3, 5) for e in un._starts(k, 42, 3, 300)]
    own = [e.fit(vec.persist()) for e in starts]
    for mine, model in zip(un._fit_all(vec, dim, starts), own):
        assert np.allclose(mine.clusterCenters(), model.clusterCenters(), atol=1e-9)
        assert mine.cost == pytest.approx(model.summary.trainingCost, rel=1e-9)
        assert mine.transform(vec).select("Cluster").collect() == model.transform(vec).select("Cluster").collect()


def test_all_fits_share_a_pass(spark, points, monkeypatch):
    vec, dim = points
    sizes, real = [], un._step
    monkeypatch.setattr(un, "_step", lambda blocks, d, fits: sizes.append(len(fits)) or real(blocks, d, fits))
    starts = [e for k in (2, 3) for e in un._starts(k, 42, 4, 5)]
    assert len(un._fit_all(vec.persist(), dim, starts)) == 8
    assert sizes[0] == 8 and len(sizes) <= 5 and sizes == sorted(sizes, reverse=True)


def test_step_takes_the_first_of_equal_centres_and_keeps_empty_ones(spark):
    x = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0]])
    blocks = spark.sparkContext.parallelize([x[:2].tobytes(), x[2:].tobytes()], 2)
    sums, counts, costs = un._step(blocks, 2, [np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 0.0]]), np.array([[1.0, 0.0]])])
    assert counts.tolist() == [2.0, 1.0, 0.0, 3.0] and costs.tolist() == [1.0, 2.0]
    assert sums.tolist() == [[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [3.0, 0.0]]


@pytest.mark.parametrize("kind", ["rf_reg", "gbt_reg", "gbt_clf"])
def test_trees_keep_no_node_ids(spark, kind):
    assert not ml.make_estimator(kind).getCacheNodeIds()


def test_fits_run_at_the_same_time(spark):
    assert ml.make_estimator("gbt_clf", n_classes=3).getParallelism() == ml.FITS_AT_ONCE > 1


def test_first_centres_are_sparks_without_its_fits(spark, monkeypatch):
    """k-means|| of all starts in shared passes: the same centres as a fit of no steps, over several partitions of unlike size."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (3000, 2)) * [1.0, 3.0]
    df = spark.createDataFrame([(*map(float, p),) for p in x], "x double, y double").repartition(5).where("x > -2 or y > 0")
    vec, dim = un._scaled_vectors(df.persist(), ["x", "y"], None)
    starts = [e for k in (2, 3, 7) for e in un._starts(k, 42, 4, 300)]
    want = [np.array(e.fit(vec, {e.maxIter: 0}).clusterCenters()) for e in starts]
    monkeypatch.setattr(un.KMeans, "fit", None)
    placed = un._blocks(vec, dim)
    for blocks in (placed, placed.repartition(3)):
        for mine, theirs in zip(un._first_centers(blocks, dim, starts), want):
            assert np.allclose(mine, theirs, rtol=0, atol=1e-12)
    assert len(un._fit_all(vec, dim, starts)) == len(starts)


def test_first_centres_of_few_distinct_rows(spark):
    """Fewer distinct rows than centres: as many centres as there are, as in Spark."""
    df = spark.createDataFrame([(float(i % 2), 1.0) for i in range(9)], "x double, y double").coalesce(1)
    vec, dim = un._scaled_vectors(df, ["x", "y"], None)
    starts = un._starts(3, 42, 3, 300)
    own = [e.fit(vec) for e in starts]
    for mine, model in zip(un._fit_all(vec, dim, starts), own):
        assert np.allclose(mine.clusterCenters(), model.clusterCenters(), atol=1e-12)


def test_random_numbers_are_the_jvms(spark):
    from framewise.functions import jvm_random as r
    for seed in (0, 42, -7, 2 ** 40 + 3):
        java, own = spark._jvm.java.util.Random(seed), r.JavaRandom(seed)
        assert [java.nextInt(), java.nextInt(7), java.nextInt(8), java.nextLong(), java.nextDouble()] == \
            [own.next_int(), own.next_int(7), own.next_int(8), own.next_long(), own.next_double()]
        one = r.XorShift(seed)
        numbers = [one.next_double() for _ in range(900)]
        assert r.doubles([seed, 1], 0, 900)[0].tolist() == numbers
        assert r.doubles([1, seed], 333, 401)[1].tolist() == numbers[333:734]
    for n, parts in ((1, 2), (5, 3), (60, 7), (5000, 3)):
        df = spark.range(0, n, 1, parts)
        sizes = [n * (p + 1) // parts - n * p // parts for p in range(parts)]
        for seed in range(4):
            p, i = r.take_one(sizes, seed)
            assert sum(sizes[:p]) + i == df._jdf.javaRDD().takeSample(False, 1, seed)[0]
