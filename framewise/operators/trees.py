"""Forests and boosted trees on large tables, grown from cells of binned rows.

Spark's tree learners look at every row once per level and tree, though all they use of a row are its features' bins (at most
``maxBins`` a feature), its label and its weight. Rows with the same bins, a *cell*, always share a node. So the rows are read
once, for each cell's number, mean and spread of labels; from these, boosting is exact: a round's residuals differ inside a cell
only by the label. A forest reads the rows once more and draws each row's Poisson count for every tree, summed by cell.

Bins are those of Spark's learners (same sample, same thresholds), as are gains, stopping rules and models; boosted trees are
Spark's up to rounding. A forest's draws come from another generator, so it is another forest of the same kind. Small
tables, tables of too many cells and settings that need rows go to Spark's learner."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.jvm_random import XorShift
from framewise.session import ensure_checkpoint_dir

SMALL = 200_000  # rows up to which Spark's learner is used
MAX_CELLS = 1 << 18  # cells beyond which it is, too
HELD = 1 << 19  # rows that a task sums up at once
FOREST_ROWS = 1 << 15  # rows that counts are drawn for at once
FOREST_VALUES = 1 << 22  # cells x trees that a task sums up in one pass
BLOCK_VALUES = 1 << 18  # cells x trees that are put together in one task
LEAF = -1


@dataclass
class Cells:
    """Distinct rows of bins, with number, mean and sum of squared deviations of the labels, or numbers by class."""
    bins: np.ndarray
    codes: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    by_class: np.ndarray
    thresholds: list[np.ndarray]


def fit(est, data: DataFrame):
    """``est.fit(data)`` for a forest regressor, boosted trees or one-vs-rest of these."""
    inner = est.getClassifier() if isinstance(est, OneVsRest) else est
    if not _plain(est, inner):
        return est.fit(data)
    label, features = est.getLabelCol(), est.getFeaturesCol()
    classes = isinstance(inner, GBTClassifier)
    total = data.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"), F.max(label).alias("top")).first()
    if total["n"] <= SMALL or not math.isfinite(total["mean"]):
        return est.fit(data)
    rows = data.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    thresholds = _thresholds(rows.select("x"), total["n"], inner.getMaxBins(), inner.getSeed())
    cells = _cells(rows, thresholds, total["n"], total["mean"], int(total["top"]) + 1 if classes else 0)
    if cells is None:
        return est.fit(data)
    spark = data.sparkSession
    if isinstance(inner, RandomForestRegressor):
        trees = _forest(rows, cells, total["mean"], inner, inner.getNumTrees(), inner.getSeed())
        return _model(spark, RandomForestRegressionModel, inner, trees, [1.0] * len(trees), thresholds)
    weights = [1.0] + [inner.getStepSize()] * (inner.getMaxIter() - 1)
    if not classes:
        return _model(spark, GBTRegressionModel, inner, _boosted(cells, inner), weights, thresholds)
    if not isinstance(est, OneVsRest):
        return _model(spark, GBTClassificationModel, inner, _boosted(cells, inner, cells.by_class[:, 1]), weights, thresholds)
    models = [_model(spark, GBTClassificationModel, inner, _boosted(cells, inner, cells.by_class[:, k]), weights, thresholds)
              for k in range(cells.by_class.shape[1])]
    return est._copyValues(OneVsRestModel(models=models))


def _plain(est, inner) -> bool:
    """Whether nothing but bins and labels of whole rows decides."""
    def given(name: str):
        p = inner.hasParam(name) and inner.getParam(name)
        return inner.getOrDefault(p) if p and inner.isDefined(p) else None

    boosted = isinstance(inner, (GBTRegressor, GBTClassifier))
    if not (boosted or isinstance(inner, RandomForestRegressor)) or (est is not inner and not isinstance(inner, GBTClassifier)):
        return False
    return (given("subsamplingRate") == 1.0 and given("featureSubsetStrategy") == "all" and given("impurity") == "variance"
            and given("minWeightFractionPerNode") == 0.0 and not given("weightCol") and not given("validationIndicatorCol")
            and not given("leafCol") and given("bootstrap") in (None, True) and given("lossType") in (None, "squared", "logistic"))


# ---------------------------------------------------------------------- bins
def _thresholds(x: DataFrame, n: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Per feature, the values between its bins, from the rows that Spark's learners sample for them."""
    wanted, max_bins = max(max_bins * max_bins, 10_000), min(max_bins, n)
    fraction = min(1.0, wanted / n)
    if fraction < 1:
        spark, rows = x.sparkSession, x._jdf.javaRDD().sample(False, fraction, XorShift(seed).next_int())
        x = DataFrame(spark._jsparkSession.createDataFrame(rows, x._jdf.schema()), spark)
    got = x.toArrow()["x"].combine_chunks()
    values = got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1)
    return [_between(values[:, j], fraction * n, max_bins - 1) for j in range(values.shape[1])]


def _between(x: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most about ``most`` thresholds half way between sampled values, so that as many values lie in each bin. Zeros are not
    counted but follow from the ``expected`` number of values."""
    x = x[x != 0]
    values, counts = np.unique(x, return_counts=True)
    counts = counts.astype(float)
    if not len(values):
        return np.zeros(0)
    if expected - len(x) > np.finfo(float).eps * len(x) * 100:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, expected - len(x))
    if len(values) - 1 <= most:
        return (values[:-1] + values[1:]) / 2.0
    stride = expected / (most + 1)
    out, seen, target = [], counts[0], stride
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append((values[i - 1] + values[i]) / 2.0)
            target += stride
    return np.array(out)


def _coded(batch: pa.RecordBatch, thresholds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bins as one number, and its label."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(thresholds))
    code = np.zeros(batch.num_rows, np.int64)
    for j, t in enumerate(thresholds):
        code = code * (len(t) + 1) + np.searchsorted(t, x[:, j])
    return code, batch.column(1).to_numpy(zero_copy_only=False)


def _cells(rows: DataFrame, thresholds: list[np.ndarray], n: int, mean: float, classes: int) -> Cells | None:
    """The cells of all rows; None if there are too many to gain from them. With ``classes``, a label is part of the key."""
    if math.prod(len(t) + 1 for t in thresholds) * max(classes, 1) >= 1 << 62:
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append(_coded(batch, thresholds))
            many += batch.num_rows
            if many >= HELD:
                yield summed(held)
                held, many = [], 0
        if many:
            yield summed(held)

    def summed(held: list[tuple]) -> pa.RecordBatch:
        code, y = (np.concatenate(a) for a in zip(*held))
        if classes:
            code, y = code * classes + y.astype(np.int64), np.zeros(len(y))
        key, which, count = np.unique(code, return_inverse=True, return_counts=True)
        y = y if classes else y - mean
        return pa.record_batch([pa.array(key), pa.array(count), pa.array(np.bincount(which, y)), pa.array(np.bincount(which, y * y))],
                               names=["code", "n", "s", "q"])

    sums = rows.mapInArrow(part, "code long, n long, s double, q double").groupBy("code").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    most = min(MAX_CELLS, n // 4)
    got = sums.limit(most * max(classes, 1) + 1).toArrow()
    code, count, s, q = (got[c].to_numpy() for c in ("code", "n", "s", "q"))
    order = np.argsort(code)
    code, count, s, q = code[order], count[order].astype(float), s[order], q[order]
    by_class = np.zeros((0, 0))
    if classes:
        code, label = np.divmod(code, classes)
        code, which = np.unique(code, return_inverse=True)
        by_class = np.zeros((len(code), classes))
        by_class[which, label] = count
        count, s, q = by_class.sum(axis=1), np.zeros(len(code)), np.zeros(len(code))
    if len(code) > most:
        return None
    bins, left = np.empty((len(code), len(thresholds)), np.int64), code.copy()
    for j in range(len(thresholds) - 1, -1, -1):
        left, bins[:, j] = np.divmod(left, len(thresholds[j]) + 1)
    return Cells(bins, code, count, mean + s / count, np.maximum(q - s * s / count, 0.0), by_class, thresholds)


# ---------------------------------------------------------------------- trees
def _impurity(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Variance, from number, sum and sum of squares."""
    safe = np.where(n > 0, n, 1.0)
    return np.where(n > 0, (q - s * s / safe) / safe, 0.0)


def _best(bins: np.ndarray, node: np.ndarray, many: int, sums: list[np.ndarray], sizes: list[int], least: float,
          min_gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node its best split: gain (-inf: none), feature, last bin to the left, and number, sum and squares to the left."""
    gain, feature, split = np.full(many, -np.inf), np.zeros(many, np.int64), np.zeros(many, np.int64)
    left = np.zeros((3, many))
    for j, size in enumerate(sizes):
        if size < 2:
            continue
        at = node * size + bins[:, j]
        upto = np.stack([np.bincount(at, v, minlength=many * size).reshape(many, size).cumsum(axis=1) for v in sums])
        a, b = upto[:, :, :-1], upto[:, :, -1:] - upto[:, :, :-1]
        whole = upto[:, :, -1]
        share = a[0] / np.maximum(whole[0], 1e-300)[:, None]
        g = _impurity(*whole)[:, None] - share * _impurity(*a) - (1.0 - share) * _impurity(*b)
        g[(a[0] < least) | (b[0] < least) | (g < min_gain)] = -np.inf
        k = g.argmax(axis=1)
        mine = g[np.arange(many), k]
        new = mine > gain
        gain[new], feature[new], split[new] = mine[new], j, k[new]
        left[:, new] = a[:, np.arange(many), k][:, new]
    return gain, feature, split, left


def _grow(cells_bins: np.ndarray, sums: list[np.ndarray], sizes: list[int], depth: int, least: float, min_gain: float,
          shift: float = 0.0) -> tuple[dict, np.ndarray]:
    """A tree, level by level, as columns of nodes, and each cell's prediction. ``sums``: per cell the rows' number, sum and sum
    of squares of ``label - shift``."""
    tree = {k: [] for k in ("feature", "split", "gain", "child", "n", "s", "q")}

    def add(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
        first = len(tree["n"])
        for k, v in (("n", n), ("s", s), ("q", q)):
            tree[k] += v.tolist()
        for k, v in (("feature", LEAF), ("split", 0), ("gain", -1.0), ("child", LEAF)):
            tree[k] += [v] * len(n)
        return first + np.arange(len(n))

    total = [np.array([v.sum()]) for v in sums]
    ids = add(*total)
    home = np.zeros(len(cells_bins), np.int64)  # the node each cell is in
    open_ = ids if depth else ids[:0]
    for level in range(depth):
        if not len(open_):
            break
        place = np.full(len(tree["n"]), -1)
        place[open_] = np.arange(len(open_))
        here = np.flatnonzero(place[home] >= 0)
        node = place[home[here]]
        gain, feature, split, left = _best(cells_bins[here], node, len(open_), [v[here] for v in sums], sizes, least, min_gain)
        use = np.flatnonzero(gain > 0)
        if not len(use):
            break
        whole = np.array([[tree[k][i] for i in open_[use].tolist()] for k in ("n", "s", "q")])
        a = left[:, use]
        pairs = np.stack((a, whole - a), axis=2).reshape(3, -1)  # left and right child next to each other
        children = add(*pairs)
        for i, u in zip(open_[use].tolist(), range(len(use))):
            tree["feature"][i], tree["split"][i] = int(feature[use[u]]), int(split[use[u]])
            tree["gain"][i], tree["child"][i] = float(gain[use[u]]), int(children[2 * u])
        number = np.full(len(open_), -1)
        number[use] = np.arange(len(use))
        moved = number[node] >= 0
        here, node = here[moved], node[moved]
        right = cells_bins[here, feature[node]] > split[node]
        home[here] = children[2 * number[node] + right]
        pure = np.abs(_impurity(*pairs)) < 2.0 ** -52
        open_ = children[~pure] if level + 1 < depth else children[:0]
    n, s, q = (np.array(tree[k]) for k in ("n", "s", "q"))
    safe = np.where(n > 0, n, 1.0)
    tree["value"] = (np.where(n > 0, s / safe, 0.0) + shift).tolist()
    tree["impurity"] = _impurity(n, s, q).tolist()
    tree["s"], tree["q"] = (s + n * shift).tolist(), (q + 2 * shift * s + n * shift * shift).tolist()
    return tree, np.array(tree["value"])[home]


def _sizes(cells: Cells) -> list[int]:
    return [len(t) + 1 for t in cells.thresholds]


def _boosted(cells: Cells, est, positive: np.ndarray | None = None) -> list[dict]:
    """The rounds of boosting: of squared loss, or with the number of ``positive`` rows per cell, of log loss."""
    settings = _sizes(cells), est.getMaxDepth(), float(est.getMinInstancesPerNode()), est.getMinInfoGain()
    n = cells.n
    shift = 0.0
    if positive is None:
        shift = float((n * cells.mean).sum() / n.sum())
        d = cells.mean - shift
        sums = [n, n * d, cells.spread + n * d * d]
    else:
        sums = [n, 2.0 * positive - n, n]
    trees, margin, rate = [], np.zeros(len(n)), 1.0
    for _ in range(est.getMaxIter()):
        tree, value = _grow(cells.bins, sums, *settings, shift)
        trees.append(tree)
        margin, rate, shift = margin + rate * value, est.getStepSize(), 0.0
        if positive is None:
            d = 2.0 * (cells.mean - margin)
            sums = [n, n * d, 4.0 * cells.spread + n * d * d]
        else:
            with np.errstate(over="ignore"):
                up, down = 4.0 / (1.0 + np.exp(2.0 * margin)), -4.0 / (1.0 + np.exp(-2.0 * margin))
            sums = [n, positive * up + (n - positive) * down, positive * up * up + (n - positive) * down * down]
    return trees


def _forest(rows: DataFrame, cells: Cells, mean: float, est, many: int, seed: int) -> list[dict]:
    """``many`` trees, each of rows that count as often as drawn (Poisson, mean 1). Passes take as many trees as a task can sum
    up; the sums of a block of trees are put together and grown in one task."""
    context = rows.sparkSession.sparkContext
    settings = _sizes(cells), est.getMaxDepth(), float(est.getMinInstancesPerNode()), est.getMinInfoGain()
    size, codes, bins, thresholds = len(cells.codes), cells.codes, cells.bins, cells.thresholds
    block = max(1, min(10, BLOCK_VALUES // size))
    at_once = max(block, min(many, FOREST_VALUES // size) // block * block)
    few = rows.coalesce(2 * context.defaultParallelism)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes and labels of some tens of thousands of rows at a time."""
        got, n = [], 0
        for batch in batches:
            got.append(_coded(batch, thresholds))
            n += batch.num_rows
            if n >= FOREST_ROWS:
                yield tuple(np.concatenate(a) for a in zip(*got))
                got, n = [], 0
        if n:
            yield tuple(np.concatenate(a) for a in zip(*got))

    trees: list[dict] = []
    for first in range(0, many, at_once):
        now = min(at_once, many - first)

        def part(batches: Iterator[pa.RecordBatch], now=now, first=first) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng([seed & (1 << 64) - 1, first, TaskContext.get().partitionId()])
            sums = np.zeros((3, size, now))
            for code, y in held(batches):
                order = np.argsort(code, kind="stable")
                code, y = code[order], (y[order] - mean)[:, None]
                edge = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                at, w = np.searchsorted(codes, code[edge]), rng.poisson(1.0, (len(code), now)).astype(float)
                sums[0, at] += np.add.reduceat(w, edge)
                w *= y
                sums[1, at] += np.add.reduceat(w, edge)
                w *= y
                sums[2, at] += np.add.reduceat(w, edge)
            for lo in range(0, now, block):
                mine = np.ascontiguousarray(sums[:, :, lo:lo + block])
                yield pa.record_batch([pa.array([first + lo], pa.int32()), pa.array([mine.tobytes()], pa.binary())], names=["b", "sums"])

        def grown(item: tuple) -> list:
            b, sums = item
            sums = sums.reshape(3, size, -1)
            out = []
            for i in range(sums.shape[2]):
                live = np.flatnonzero(sums[0, :, i] > 0)
                tree, _ = _grow(bins[live], [np.ascontiguousarray(v[live, i]) for v in sums], *settings, mean)
                out.append((b + i, tree))
            return out

        summed = few.mapInArrow(part, "b int, sums binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1])))
        got = summed.reduceByKey(lambda a, b: a + b, -(-now // block)).flatMap(grown).collect()
        trees += [t for _, t in sorted(got, key=lambda x: x[0])]
    return trees


# --------------------------------------------------------------------- models
def _preorder(tree: dict, thresholds: list[np.ndarray]) -> list[tuple]:
    """Nodes in Spark's order of storing: a node, what is left of it, what is right of it. Twin leaves of one value are one."""
    def rows(i: int) -> list[tuple]:
        stats = [tree["n"][i], tree["s"][i], tree["q"][i]]
        leaf = (tree["value"][i], tree["impurity"][i], stats, -1.0, 0, LEAF, 0.0)
        if tree["child"][i] == LEAF:
            return [leaf]
        a, b = rows(tree["child"][i]), rows(tree["child"][i] + 1)
        if len(a) == len(b) == 1 and a[0][0] == b[0][0]:
            return [(a[0][0], *leaf[1:])]
        f = tree["feature"][i]
        node = (tree["value"][i], tree["impurity"][i], stats, tree["gain"][i], len(a) + 1, f, float(thresholds[f][tree["split"][i]]))
        return [node, *a, *b]

    return rows(0)


def _model(spark: SparkSession, kind, est, trees: list[dict], weights: list[float], thresholds: list[np.ndarray]):
    """Spark's model of these trees: written in the form its models are stored in, and loaded."""
    def meta(name: str, uid: str, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {}, "defaultParamMap": {}, **more})

    set_, default = ({p.name: v for p, v in m.items()} for m in (est._paramMap, est._defaultParamMap))
    nodes = [(i, k, *row) for i, t in enumerate(trees) for k, row in enumerate(_preorder(t, thresholds))]
    tree, k, value, impurity, stats, gain, right, feature, at = zip(*nodes)
    inner = np.array(feature) != LEAF
    k, right = np.array(k), np.array(right)
    split = pa.StructArray.from_arrays(
        [pa.array(feature, pa.int32()), pa.array([[t] if f != LEAF else [] for t, f in zip(at, feature)], pa.list_(pa.float64())),
         pa.array([-1] * len(k), pa.int32())], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    data = pa.StructArray.from_arrays(
        [pa.array(k, pa.int32()), pa.array(value, pa.float64()), pa.array(impurity, pa.float64()),
         pa.array(stats, pa.list_(pa.float64())), pa.array([round(s[0]) for s in stats], pa.int64()), pa.array(gain, pa.float64()),
         pa.array(np.where(inner, k + 1, -1), pa.int32()), pa.array(np.where(inner, k + right, -1), pa.int32()), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    path = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4()}"
    area = "classification" if kind is GBTClassificationModel else "regression"
    top = meta(f"{area}.{kind.__name__}", est.uid, paramMap=set_, defaultParamMap=default, numFeatures=len(thresholds), numTrees=len(trees))
    spark.createDataFrame([(top,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(i, meta("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}"), w) for i, w in enumerate(weights)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(pa.table({"treeID": pa.array(tree, pa.int32()), "nodeData": data})).coalesce(1).write.parquet(f"{path}/data")
    return kind.load(path)
