"""PCA and K-Means on standardised columns (Spark ML), elbow curve."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import q
from framewise.functions.jvm_random import JavaRandom, XorShift, doubles, take_one


def _scaled_vectors(df: DataFrame, cols: Sequence[str] | None, array_col: str | None,
                    keep: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Drop rows missing any input, standardise each input with its mean and
    population std (one aggregate), assemble a ``features`` vector. An array
    shorter than the longest one misses its last inputs."""
    keep = [q(c) for c in keep]
    if array_col:
        d = df.select(*keep, q(array_col).alias("_arr")).where(F.col("_arr").isNotNull())
        dim = d.select(F.max(F.size("_arr"))).first()[0] or 0
        d = d.select(*[F.col(c) for c in d.columns if c != "_arr"],
                     *[F.get("_arr", F.lit(i)).cast("double").alias(f"_x{i}") for i in range(dim)])
        names = [f"_x{i}" for i in range(dim)]
    else:
        names = list(cols)
        d = df.select(*keep, *[q(c).cast("double").alias(c) for c in names])
    d = d.dropna(subset=names)
    row = d.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(names)],
                *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(names)]).first()
    z = []
    for i, c in enumerate(names):
        m, s = row[f"m{i}"], row[f"s{i}"]
        z.append(((F.col(f"`{c}`") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)).alias(f"_z{i}"))
    d = d.select(*[F.col(f"`{c}`") for c in d.columns if c not in names], *z)
    va = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(names))], outputCol="features")
    out = va.transform(d).drop(*[f"_z{i}" for i in range(len(names))])
    return out, len(names)


def pca_model(df: DataFrame, cols: Sequence[str] | None = None, k: int = 2, array_col: str | None = None,
              keep: Sequence[str] = ()):
    vec, dim = _scaled_vectors(df, cols, array_col, keep)
    if not 1 <= k <= min(dim, 10):
        raise ValueError(f"k must be within 1..{min(dim, 10)}")
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(vec)
    return model, vec


def _signs(model) -> list[float]:
    """Make each component's largest-magnitude loading positive (a fixed sign)."""
    pc = model.pc.toArray()
    out = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        i = int(abs(col).argmax())
        out.append(1.0 if col[i] >= 0 else -1.0)
    return out


def pca(df: DataFrame, cols: Sequence[str] | None = None, k: int = 2, array_col: str | None = None,
        keep: Sequence[str] = ()) -> DataFrame:
    """project standardised inputs on the first ``k`` components
    (``PC1..PCk``); rows missing an input are dropped first."""
    model, vec = pca_model(df, cols, k, array_col, keep)
    sg = _signs(model)
    out = model.transform(vec).withColumn("_a", vector_to_array("_pc"))
    return out.select(*[q(c) for c in keep], *[(F.col("_a")[j] * F.lit(sg[j])).alias(f"PC{j + 1}")
                                               for j in range(k)])


def pca_loadings(df: DataFrame, cols: Sequence[str] | None = None, k: int = 2,
                 array_col: str | None = None) -> DataFrame:
    model, vec = pca_model(df, cols, k, array_col)
    pc, sg = model.pc.toArray(), _signs(model)
    names = list(cols) if cols else [f"{array_col}[{i}]" for i in range(pc.shape[0])]
    rows = [(names[i], *[float(pc[i, j] * sg[j]) for j in range(k)]) for i in range(pc.shape[0])]
    return df.sparkSession.createDataFrame(rows, "input string, " + ", ".join(f"PC{j + 1} double" for j in range(k)))


def pca_variance(df: DataFrame, cols: Sequence[str] | None = None, k: int = 2,
                 array_col: str | None = None, mark: float = 0.95) -> DataFrame:
    """F4 + W6: explained variance ratio per component, cumulative, and whether
    the cumulative share has reached ``mark``."""
    model, _ = pca_model(df, cols, k, array_col)
    ev = [float(v) for v in model.explainedVariance.toArray()]
    rows, cum = [], 0.0
    for j, v in enumerate(ev):
        cum += v
        rows.append((j + 1, v, cum, cum >= mark))
    return df.sparkSession.createDataFrame(
        rows, "component int, explained_variance_ratio double, cumulative double, reaches_mark boolean")


def _tol(k: int, rel: float = 1e-4) -> float:
    """Convergence like scikit-learn's: stop when the summed squared centre
    shift is below ``rel`` x the mean feature variance (1 after scaling).
    Spark tests each centre's shift, so spread that budget over the k centres."""
    return math.sqrt(rel / k)


BLOCK_VALUES = 1 << 16  # doubles in one block of vectors
CHUNK = 4096  # vectors that are compared with all centres at once


@dataclass
class KMeansFit:
    """Centres in the standardised space and the within-cluster cost of the last step."""
    centers: list[np.ndarray]
    cost: float

    def clusterCenters(self) -> list[np.ndarray]:
        return self.centers

    def transform(self, vec: DataFrame) -> DataFrame:
        """``vec`` with ``Cluster``, the number of the nearest centre (the first among equally near ones)."""
        centers = np.array(self.centers)

        @F.arrow_udf("int")
        def nearest(vectors: pa.Array) -> pa.Array:
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, centers.shape[1])
            return pa.array(_scores(x, centers).argmin(axis=0), pa.int32())

        return vec.withColumn("Cluster", nearest(vector_to_array("features")))


def _ones(x: np.ndarray) -> np.ndarray:
    """``x`` with a last column of ones."""
    return np.concatenate((x, np.ones((len(x), 1))), axis=1)


def _scores(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of every centre (a row each) to every row of ``x``, less that row's squared length."""
    return np.concatenate((-2.0 * centers, (centers * centers).sum(axis=1)[:, None]), axis=1) @ _ones(x).T


def _blocks(vec: DataFrame, dim: int) -> RDD:
    """The vectors as ``(partition, place of the first row in it, bytes of doubles)``, many to an element."""
    rows = max(1, BLOCK_VALUES // max(dim, 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= rows:
                yield pa.record_batch([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block"])
                held, n = [], 0
        if n:
            yield pa.record_batch([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block"])

    def place(part: int, blobs: Iterator) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        for r in blobs:
            yield part, at, bytes(r[0])
            at += len(r[0]) // (8 * dim)

    packed = vec.select(vector_to_array("features").alias("x")).mapInArrow(pack, "block binary")
    return packed.rdd.mapPartitionsWithIndex(place)


# ------------------------------------------------------------- first centres (k-means||)
def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centre."""
    out = np.zeros((len(centers), len(x)))
    for j in range(x.shape[1]):
        d = centers[:, j, None] - x[None, :, j]
        out += d * d
    return out


def _chunks(dim: int, blob: bytes) -> Iterator[tuple[int, np.ndarray]]:
    rows = np.frombuffer(blob).reshape(-1, dim)
    return ((i, rows[i:i + CHUNK]) for i in range(0, len(rows), CHUNK))


def _nearest(x: np.ndarray, centers: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Per start, every row's squared distance to its nearest centre."""
    score, square, lo = _scores(x, np.concatenate(centers)), np.einsum("ij,ij->i", x, x), 0
    for c in centers:
        yield np.maximum(square + score[lo:lo + len(c)].min(axis=0), 0.0)
        lo += len(c)


def _costs(placed: RDD, dim: int, centers: list[np.ndarray]) -> np.ndarray:
    """Each start's sum of squared distances to its nearest centre so far."""
    def part(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        out = np.zeros(len(centers))
        for _, _, blob in blocks:
            for _, x in _chunks(dim, blob):
                out += [cost.sum() for cost in _nearest(x, centers)]
        yield out

    return placed.mapPartitions(part).treeReduce(lambda a, b: a + b)


def _drawn(placed: RDD, dim: int, centers: list[np.ndarray], seeds: list[int], rates: list[float]) -> list[np.ndarray]:
    """Each start's rows that are drawn with probability ``rate`` times their cost, in order. The numbers are those that
    Spark's KMeans draws: per start and partition one generator, one number a row."""
    def part(blocks: Iterator[tuple]) -> Iterator[tuple]:
        for p, at, blob in blocks:
            u = doubles([s ^ p for s in seeds], at, len(blob) // (8 * dim))
            for i, x in _chunks(dim, blob):
                for j, cost in enumerate(_nearest(x, centers)):
                    hit = np.flatnonzero(u[j, i:i + len(x)] < rates[j] * cost)
                    yield from ((j, p, at + i + int(k), x[k].tolist()) for k in hit)

    got = sorted(placed.mapPartitions(part).collect())
    return [np.array([r[3] for r in got if r[0] == j]).reshape(-1, dim) for j in range(len(centers))]


def _nearest_counts(placed: RDD, dim: int, centers: list[np.ndarray]) -> list[np.ndarray]:
    """Per start, the number of rows that each of its candidates is nearest to (the first among equally near ones)."""
    _, counts, _ = _step(placed.map(lambda b: b[2]), dim, centers)
    return np.split(counts, np.cumsum([len(c) for c in centers])[:-1])


def _pick(points: np.ndarray, weights: np.ndarray, k: int, steps: int = 30) -> np.ndarray:
    """``k`` of a start's few weighted candidates: k-means++ and Lloyd's steps, with the draws of Spark's KMeans."""
    rand = JavaRandom(0)

    def until(parts: np.ndarray) -> int:
        """How many parts it takes to reach a random share of their sum."""
        r = rand.next_double() * float(parts.sum())
        return min(int(np.searchsorted(np.cumsum(parts), r)) + 1, len(parts)) if r > 0 else 0

    centers = [points[until(weights) - 1]]
    cost = _distances(points, centers[0][None])[0]
    for _ in range(1, k):
        centers.append(points[max(until(cost * weights) - 1, 0)])
        cost = np.minimum(cost, _distances(points, centers[-1][None])[0])
    centers, old = np.array(centers), None
    for _ in range(steps):
        near = _distances(points, centers).argmin(axis=0)
        if old is not None and (near == old).all():
            break
        old = near
        for j in range(k):
            mine, n = near == j, float(weights[near == j].sum())
            centers[j] = (weights[mine, None] * points[mine]).sum(axis=0) / n if n else points[rand.next_int(len(points))]
    return centers


def _first_centers(placed: RDD, dim: int, starts: Sequence[KMeans]) -> list[np.ndarray]:
    """The centres that Spark's KMeans starts from (k-means||), with all starts in the same passes: a random row, rows drawn by
    their distance in each of its steps, and k of these by their weight."""
    sizes = dict(placed.map(lambda b: (b[0], len(b[2]) // (8 * dim))).reduceByKey(lambda a, b: a + b).collect())
    seeds = [XorShift(s.getSeed()).next_int() for s in starts]
    at = [take_one([sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)], seed) for seed in seeds]

    def chosen(block: tuple) -> Iterator[tuple]:
        p, lo, blob = block
        rows = np.frombuffer(blob).reshape(-1, dim)
        return ((j, rows[i - lo]) for j, (q_, i) in enumerate(at) if q_ == p and lo <= i < lo + len(rows))

    first = dict(placed.flatMap(chosen).collect())
    centers = [first[j][None] for j in range(len(starts))]
    for step in range(max((s.getInitSteps() for s in starts), default=0)):
        live = [j for j, s in enumerate(starts) if step < s.getInitSteps()]
        sums = _costs(placed, dim, [centers[j] for j in live])
        rates = [2.0 * starts[j].getK() / c if c > 0 else 0.0 for j, c in zip(live, sums.tolist())]
        more = _drawn(placed, dim, [centers[j] for j in live], [seeds[j] ^ step << 16 for j in live], rates)
        for j, x in zip(live, more):
            centers[j] = np.concatenate((centers[j], x))
    centers = [np.array(list(dict.fromkeys(map(tuple, c.tolist())))) for c in centers]
    many = [j for j, s in enumerate(starts) if len(centers[j]) > s.getK()]
    if many:
        for j, n in zip(many, _nearest_counts(placed, dim, [centers[j] for j in many])):
            centers[j] = _pick(centers[j], n, starts[j].getK())
    return centers


def _step(blocks: RDD, dim: int, fits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass for all ``fits``: each cluster's sum of vectors and number of rows, and each fit's cost."""
    centers = np.concatenate(fits)
    ends = np.cumsum([len(f) for f in fits]).tolist()
    first = [0, *ends[:-1]]
    weights = np.concatenate((-2.0 * centers, (centers * centers).sum(axis=1)[:, None]), axis=1)

    def part(blobs: Iterator[bytes]) -> Iterator[tuple]:
        sums, counts, costs = np.zeros_like(centers), np.zeros(len(centers)), np.zeros(len(ends))
        for blob in blobs:
            rows = np.frombuffer(blob).reshape(-1, dim)
            for x in (rows[i:i + CHUNK] for i in range(0, len(rows), CHUNK)):
                x1 = _ones(x)
                score, square, lo = weights @ x1.T, np.einsum("ij,ij->i", x, x), 0
                mine = np.empty(score.shape)
                for i, hi in enumerate(ends):
                    best = score[lo:hi].min(axis=0)
                    np.equal(score[lo:hi], best, out=mine[lo:hi])
                    costs[i] += np.maximum(square + best, 0.0).sum()
                    lo = hi
                got = mine @ x1
                if (np.add.reduceat(got[:, -1], first) != len(x)).any():  # equally near centres: the first one
                    for lo, hi in zip(first, ends):
                        mine[lo:hi] *= mine[lo:hi].cumsum(axis=0) == 1
                    got = mine @ x1
                sums += got[:, :-1]
                counts += got[:, -1]
        yield sums, counts, costs

    return blocks.mapPartitions(part).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b)))


def _fit_all(vec: DataFrame, dim: int, starts: Sequence[KMeans]) -> list[KMeansFit]:
    """Every estimator of ``starts`` fitted to ``vec``. The first centres are those of Spark's KMeans (k-means||) and the steps
    Lloyd's as there, but one pass over the vectors serves all the fits that have not converged, so there are as many passes as
    the longest fit has steps."""
    placed = _blocks(vec, dim).persist(StorageLevel.MEMORY_AND_DISK)
    n = placed.count()
    if not n:
        raise ValueError("no rows to cluster")
    parts = min(n, vec.sparkSession.sparkContext.defaultParallelism)
    vec.unpersist()
    if placed.getNumPartitions() < parts:  # a table of few, large files
        few, placed = placed, placed.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
        placed.count()
        few.unpersist()
    first, blocks = _first_centers(placed, dim, starts), placed.map(lambda b: b[2])
    centers, cost, active, done = list(first), [0.0] * len(starts), list(range(len(starts))), 0
    while active := [i for i in active if done < starts[i].getMaxIter()]:
        sums, counts, costs = _step(blocks, dim, [centers[i] for i in active])
        lo, moving = 0, []
        for i, c in zip(active, costs):
            hi = lo + len(centers[i])
            n = counts[lo:hi, None]
            new = np.where(n > 0, sums[lo:hi] / np.maximum(n, 1.0), centers[i])  # an empty cluster stays where it is
            if (((new - centers[i]) ** 2).sum(axis=1) > starts[i].getTol() ** 2).any():
                moving.append(i)
            centers[i], cost[i], lo = new, float(c), hi
        active, done = moving, done + 1
    placed.unpersist()
    return [KMeansFit(list(c), v) for c, v in zip(centers, cost)]


def _starts(k: int, seed: int, n_init: int, max_iter: int) -> list[KMeans]:
    return [KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=_tol(k), featuresCol="features", predictionCol="Cluster")
            for i in range(n_init)]


def kmeans_fit(df: DataFrame, cols: Sequence[str] | None = None, k: int = 3, seed: int = 42,
               n_init: int = 10, array_col: str | None = None, keep: Sequence[str] = (),
               max_iter: int = 300) -> tuple[KMeansFit, DataFrame]:
    """best of ``n_init`` K-Means fits (lowest within-cluster cost) on the
    standardised inputs. The fits share their passes over the vectors."""
    if not 2 <= k <= 10:
        raise ValueError("k must be within 2..10")
    vec, dim = _scaled_vectors(df, cols, array_col, keep)
    fits = _fit_all(vec, dim, _starts(k, seed, n_init, max_iter))
    return min(fits, key=lambda f: f.cost), vec


def kmeans(df: DataFrame, cols: Sequence[str] | None = None, k: int = 3, seed: int = 42, n_init: int = 10,
           array_col: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """cluster label ``Cluster`` per row (rows missing an input dropped)."""
    model, vec = kmeans_fit(df, cols, k, seed, n_init, array_col, keep)
    return model.transform(vec).select(*[q(c) for c in keep], F.col("Cluster").cast("int").alias("Cluster"))


def cluster_counts(assigned: DataFrame) -> DataFrame:
    """rows per cluster, ordered by cluster."""
    return assigned.groupBy("Cluster").agg(F.count(F.lit(1)).alias("count")).orderBy("Cluster")


def centroids(model: KMeansFit, names: Sequence[str]) -> DataFrame:
    """cluster centres in the standardised space."""
    from pyspark.sql import SparkSession
    rows = [(i, *[float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return SparkSession.active().createDataFrame(
        rows, "Cluster int, " + ", ".join(f"`{n}` double" for n in names))


def elbow(df: DataFrame, cols: Sequence[str] | None = None, max_k: int = 10, seed: int = 42,
          array_col: str | None = None, n_init: int = 10, max_iter: int = 300) -> DataFrame:
    """F8: within-cluster sum of squares for k = 1..min(max_k, n // 2), each the
    best of ``n_init`` fits.

    k = 1 is the total sum of squares of the centred data (one aggregate;
    Spark's KMeans refuses k = 1); the fits of all larger k share their passes
    over the vectors."""
    vec, dim = _scaled_vectors(df, cols, array_col)
    vec = vec.persist()
    n = vec.count()
    top = min(max_k, n // 2)
    arr = vec.select(vector_to_array("features").alias("_a"))
    tss = arr.select(F.aggregate("_a", F.lit(0.0), lambda acc, x: acc + x * x).alias("_s")).agg(F.sum("_s")).first()[0]
    rows = [(1, float(tss or 0.0))] if top >= 1 else []
    fits = iter(_fit_all(vec, dim, [est for k in range(2, top + 1) for est in _starts(k, seed, n_init, max_iter)]))
    for k in range(2, top + 1):
        rows.append((k, min(next(fits).cost for _ in range(n_init))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")

