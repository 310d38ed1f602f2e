"""Supervised learning on Spark ML: feature preparation, models, tuning,
metrics, persistence and scoring.

Feature preparation follows the reference's order - label-encode text
features, coerce to numbers, fill with the mean, standardise with the
*population* standard deviation - but every fitted statistic is baked into a
standard Pipeline stage (``StringIndexerModel`` or ``SQLTransformer``), so the
fitted ``PipelineModel`` is self-contained: it saves, loads and scores new
rows with exactly the training transforms.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.columns import DATETIME, NUMERIC, join_small, q
from framewise.functions.sampling import draw, numbered_copies
from framewise.operators import trees
from framewise.plans.ordered import row_index
from framewise.session import cut_lineage

FEATURES = "features"
LABEL = "label"
PREDICTION = "prediction"


def _sql_name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _lit(v: float) -> str:
    return repr(float(v)) if v == v else "NULL"


# --------------------------------------------------------------- M1, M3, M4
def label_encoders(df: DataFrame, cols: Sequence[str]) -> list:
    """M1: one ``StringIndexer`` per text column, codes in sorted order.

    Nulls are kept aside (``handleInvalid="keep"``) and turned back to null
    by :func:`feature_stages`, to be mean-filled like the reference."""
    return [StringIndexer(inputCol=c, outputCol=f"{c}__code", stringOrderType="alphabetAsc",
                          handleInvalid="keep") for c in cols]


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """``(label, code)``: the distinct texts of a column, numbered from 0 in sorted order. The sort is by ranges and the numbers
    come from the ranges' sizes, so any number of labels is encoded without a list of them on the driver."""
    labels = df.select(q(col).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    return row_index(cut_lineage(labels), ["label"], out="code")


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M1 as a transform: replace text columns by their integer codes (null stays null)."""
    names = list(df.columns)
    width = max(map(len, names))
    label, code = "_label".ljust(width + 1, "_"), "_code".ljust(width + 2, "_")  # names that no column has
    for c in cols:
        codes = label_codes(df, c).toDF(label, code)
        out = join_small(df.withColumn(label, q(c).cast("string")).drop(c), codes, [label], "left")
        df = out.withColumnRenamed(code, c).select(*[q(n) for n in names])
    return df


def standard_scale(df: DataFrame, cols: Sequence[str], out_suffix: str = "") -> DataFrame:
    """M4: ``(x - mean) / population std`` in one aggregate pass; a zero
    standard deviation gives 0, null stays null, NaN is missing and becomes
    null; booleans are not scaled."""
    cols = [c for c in cols if not isinstance(df.schema[c].dataType, T.BooleanType)]
    if not cols:
        return df
    value = {c: F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")) for c in cols}
    row = df.agg(*[F.avg(value[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(value[c]).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        x = value[c]
        if m is None:
            out[c + out_suffix] = x
        elif not s:
            out[c + out_suffix] = F.when(x.isNotNull(), F.lit(0.0))
        else:
            out[c + out_suffix] = (x - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


@dataclass
class FeatureSpec:
    features: list[str]
    text: list[str]
    numeric: list[str]
    booleans: list[str]


def classify_features(df: DataFrame, features: Sequence[str]) -> FeatureSpec:
    text, num, boo = [], [], []
    for c in features:
        dt = df.schema[c].dataType
        if isinstance(dt, T.StringType):
            text.append(c)
        elif isinstance(dt, T.BooleanType):
            boo.append(c)
        elif isinstance(dt, (NUMERIC, DATETIME)):
            num.append(c)
        else:
            raise TypeError(f"feature {c!r} has unsupported type {dt.simpleString()}")
    return FeatureSpec(list(features), text, num, boo)


def feature_stages(df: DataFrame, features: Sequence[str]) -> tuple[list, dict]:
    """Fit M1 + M3 + M4 on ``df``; return the fitted stages and their statistics.

    Output column ``features`` (vector). One distributed aggregate computes
    every mean and standard deviation."""
    spec = classify_features(df, features)
    stages: list = []
    info: dict = {"text": spec.text, "numeric": spec.numeric, "booleans": spec.booleans, "labels": {}, "modes": {}}
    if spec.text:
        enc = Pipeline(stages=label_encoders(df, spec.text)).fit(df)
        stages += enc.stages
        from framewise.operators.clean import column_modes
        for c, m in zip(spec.text, enc.stages):
            info["labels"][c] = list(m.labels)
        info["modes"] = column_modes(df, spec.text)
        df = enc.transform(df)
    # codes (null for null/unseen) and numbers as doubles
    exprs = []
    for c in spec.text:
        n = len(info["labels"][c])
        exprs.append(f"CASE WHEN {_sql_name(c + '__code')} < {n} THEN {_sql_name(c + '__code')} END AS "
                     f"{_sql_name(c + '__num')}")
    for c in spec.numeric:
        dt = df.schema[c].dataType
        if isinstance(dt, DATETIME):
            exprs.append(f"unix_micros(CAST({_sql_name(c)} AS TIMESTAMP)) / 1e6 AS {_sql_name(c + '__num')}")
        else:
            x = f"CAST({_sql_name(c)} AS DOUBLE)"
            exprs.append(f"CASE WHEN NOT isnan({x}) THEN {x} END AS {_sql_name(c + '__num')}")
    scaled = spec.text + spec.numeric
    if exprs:
        st = SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__")
        stages.append(st)
        df = st.transform(df)
    if scaled:
        # one aggregate: mean-filled values have population variance
        # var_pop(non-null) * non_null / rows
        row = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.avg(f"`{c}__num`").alias(f"m{i}") for i, c in enumerate(scaled)],
                     *[F.var_pop(f"`{c}__num`").alias(f"v{i}") for i, c in enumerate(scaled)],
                     *[F.count(f"`{c}__num`").alias(f"n{i}") for i, c in enumerate(scaled)]).first()
        means = {c: (row[f"m{i}"] if row[f"m{i}"] is not None else 0.0) for i, c in enumerate(scaled)}
        stds = {c: math.sqrt(row[f"v{i}"] * row[f"n{i}"] / row["_rows"]) if row[f"v{i}"] else 0.0
                for i, c in enumerate(scaled)}
        info["means"], info["stds"] = means, stds
        parts = []
        for c in scaled:
            filled_sql = f"coalesce({_sql_name(c + '__num')}, {_lit(means[c])})"
            body = f"({filled_sql} - {_lit(means[c])}) / {_lit(stds[c])}" if stds[c] > 0 else "0.0D"
            parts.append(f"{body} AS {_sql_name(c + '__z')}")
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__"))
    if spec.booleans:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(
            f"coalesce(CAST({_sql_name(c)} AS DOUBLE), 0.0D) AS {_sql_name(c + '__z')}" for c in spec.booleans)
            + " FROM __THIS__"))
    inputs = [f"{c}__z" for c in spec.features]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="keep"))
    return stages, info


def prepare_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """M1 + M3 + M4 applied: adds ``{col}__z`` (scaled) columns and ``features``."""
    stages, _ = feature_stages(df, features)
    return PipelineModel(stages=stages).transform(df)


# ----------------------------------------------------------------------- M2
def encode_target(df: DataFrame, target: str, max_classes: int | None = None) -> tuple[DataFrame, list[str]]:
    """M2: class labels -> ``label`` (0..k-1 in sorted order); refuses fewer than
    2 classes, or more than ``max_classes`` if given. Rows with a null target are dropped."""
    classes = df.select(q(target).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    n = classes.limit(max(max_classes or 1, 1) + 1).count()
    if max_classes and n > max_classes:
        raise ValueError(f"{target!r} has more than {max_classes} classes")
    if n < 2:
        raise ValueError(f"{target!r} needs at least two classes")
    m = StringIndexer(inputCol="_t", outputCol=LABEL, stringOrderType="alphabetAsc").fit(
        df.select(q(target).cast("string").alias("_t")).where(F.col("_t").isNotNull()))
    out = m.transform(df.withColumn("_t", q(target).cast("string")).where(F.col("_t").isNotNull())).drop("_t")
    return out, list(m.labels)


# ----------------------------------------------------------------------- M5
def split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
          key: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """M5: deterministic split by a hash of ``key``, columns that tell rows apart. Without a key the hash is of the whole row
    and its number among equal rows, so equal rows are dealt to both sides as others are.

    Unlike ``randomSplit`` the assignment does not depend on partitioning, so
    a recomputed partition lands every row on the same side."""
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must be within 0.1 .. 0.5")
    d, h, extra = draw(df, key, seed)
    h = F.pmod(h, F.lit(10_000))
    cut = int(round(test_size * 10_000))
    return d.where(h >= cut).drop(*extra), d.where(h < cut).drop(*extra)


# ------------------------------------------------------------------ M6-M12
REGRESSORS = ("linear", "rf_reg", "gbt_reg")
# tree learners: more nodes per pass over the data, and node ids cached with
# periodic checkpoints (into the shared checkpoint folder) for deep trees
TREE_DEFAULTS = {"maxMemoryInMB": 1024, "cacheNodeIds": True, "checkpointInterval": 10}
# large regressions and boosted trees: rows are led down the trees again, to the same nodes. The ids of 100 trees would be
# 400 bytes and more a row, in two generations; shallow trees are quicker without them.
NO_NODE_IDS = {**TREE_DEFAULTS, "cacheNodeIds": False}
FITS_AT_ONCE = 4  # fits of a grid, or of the classes of one-vs-rest, that run at the same time
CLASSIFIERS = ("logistic", "rf_clf", "gbt_clf")


def make_estimator(kind: str, n_classes: int = 2, n_train: int | None = None, seed: int = 42,
                   **params):
    """The estimator for a model kind, with the reference's defaults
    mapped to Spark ML (depth of forests capped at 10 by default; Spark allows 30)."""
    if kind == "linear":
        return LinearRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=0.0, solver="normal", **params)
    if kind == "logistic":
        reg = 1.0 / max(n_train or 1, 1)  # C=1 L2 penalty expressed per row
        return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, maxIter=params.pop("maxIter", 1000),
                                  regParam=params.pop("regParam", reg), elasticNetParam=0.0,
                                  standardization=False, **params)
    if kind == "rf_reg":
        return RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, numTrees=params.pop("numTrees", 100),
                                     maxDepth=params.pop("maxDepth", 10), featureSubsetStrategy="all",
                                     seed=seed, **{**NO_NODE_IDS, **params})
    if kind == "rf_clf":
        return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=params.pop("numTrees", 100),
                                      maxDepth=params.pop("maxDepth", 10), featureSubsetStrategy="sqrt",
                                      seed=seed, **{**TREE_DEFAULTS, **params})
    if kind == "gbt_reg":
        return GBTRegressor(featuresCol=FEATURES, labelCol=LABEL, maxIter=params.pop("maxIter", 100),
                            stepSize=params.pop("stepSize", 0.3), maxDepth=params.pop("maxDepth", 6),
                            seed=seed, **{**NO_NODE_IDS, **params})
    if kind == "gbt_clf":
        gbt = GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=params.pop("maxIter", 100),
                            stepSize=params.pop("stepSize", 0.3), maxDepth=params.pop("maxDepth", 6),
                            seed=seed, **{**NO_NODE_IDS, **params})
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt, featuresCol=FEATURES, labelCol=LABEL,
                                                      parallelism=FITS_AT_ONCE)
    raise ValueError(f"unknown model kind {kind!r}")


def param_grid(est, kind: str, grid: dict | None = None):
    """The reference's grids - forests: trees x depth, boosted: trees x rate."""
    grid = grid or {}
    b = ParamGridBuilder()
    if kind in ("rf_reg", "rf_clf"):
        b = b.addGrid(est.numTrees, grid.get("numTrees", [50, 100, 200]))
        b = b.addGrid(est.maxDepth, grid.get("maxDepth", [30, 10, 20]))
    elif kind in ("gbt_reg", "gbt_clf"):
        target = est.getClassifier() if isinstance(est, OneVsRest) else est
        b = b.addGrid(target.maxIter, grid.get("maxIter", [50, 100, 200]))
        b = b.addGrid(target.stepSize, grid.get("stepSize", [0.01, 0.1, 0.2]))
    return b.build()


@dataclass
class ModelBundle:
    """Unit of persistence: fitted pipeline + what it was trained for."""
    model: PipelineModel
    kind: str
    problem_type: str
    features: list[str]
    target: str
    classes: list[str] | None = None
    metrics: dict = field(default_factory=dict)
    info: dict = field(default_factory=dict)


def train(df: DataFrame, features: Sequence[str], target: str, kind: str, test_size: float = 0.2,
          seed: int = 42, tune: bool = False, grid: dict | None = None, folds: int = 3,
          fit_scope: str = "all", split_key: Sequence[str] | None = None,
          **params) -> tuple[ModelBundle, DataFrame]:
    """Fit a model the way the reference does and score the held-out rows.

    Encoders and scaler are fitted on all rows (``fit_scope="all"``, as the
    reference) or on the training rows only (``"train"``). Returns the bundle
    and the test predictions (``label``, ``prediction`` and, for classifiers,
    ``predicted_class``)."""
    features = list(features)
    problem = "classification" if kind in CLASSIFIERS else "regression"
    key, copy = list(split_key or []), []
    data = df.select(*[q(c) for c in dict.fromkeys(features + [target] + key)])
    if not key:  # equal rows are told apart by number; several jobs read them, so they are numbered once
        copy = ["_copy" + "_" * sum(c.startswith("_copy") for c in data.columns)]
        data = cut_lineage(numbered_copies(data, copy[0], _pieces(data)))
        key = data.columns
    classes = None
    if problem == "classification":
        data, classes = encode_target(data, target)
    else:
        data = data.withColumn(LABEL, q(target).cast("double")).where(F.col(LABEL).isNotNull())
    train_df, test_df = [part.drop(*copy) for part in split(data, test_size, seed, key)]
    data = data.drop(*copy)
    stages, info = feature_stages(data if fit_scope == "all" else train_df, features)
    n_train = train_df.count() if kind == "logistic" else None
    est = make_estimator(kind, len(classes or []), n_train, seed, **params)
    prep = PipelineModel(stages=stages)
    if tune and kind in ("rf_reg", "rf_clf", "gbt_reg", "gbt_clf"):
        ev = (RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="mse")
              if problem == "regression" else
              MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="accuracy"))
        cv = CrossValidator(estimator=est, estimatorParamMaps=param_grid(est, kind, grid), evaluator=ev,
                            numFolds=folds, parallelism=FITS_AT_ONCE, seed=seed)
        cvm = cv.fit(prep.transform(train_df))
        fitted = cvm.bestModel
        info["best_params"] = {p.name: v for p, v in cvm.getEstimatorParamMaps()[
            max(range(len(cvm.avgMetrics)), key=lambda i: cvm.avgMetrics[i] * (1 if ev.isLargerBetter() else -1))
        ].items()}
    else:
        ready = prep.transform(train_df)
        fitted = trees.fit(est, ready) if kind in ("rf_reg", "gbt_reg", "gbt_clf") else est.fit(ready)
    all_stages = stages + [fitted]
    if classes is not None:
        all_stages.append(IndexToString(inputCol=PREDICTION, outputCol="predicted_class", labels=classes))
    model = PipelineModel(stages=all_stages)
    pred = model.transform(test_df)
    bundle = ModelBundle(model, kind, problem, features, target, classes, {}, info)
    if problem == "regression":
        m = regression_metrics(pred).first().asDict()
    else:
        rep = classification_report(pred.withColumn("_a", F.col(LABEL)), "_a", PREDICTION)
        m = {r["class"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in rep.collect()}
    bundle.metrics = m
    return bundle, pred


def _pieces(data: DataFrame) -> int | None:
    """Partitions for the numbered rows of a large table: they are as many as the rows, however few distinct rows there are."""
    n = data.count()
    return max(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1_000_000) if n > trees.SMALL else None


# ----------------------------------------------------------------- M13-M16
def regression_metrics(pred: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """MSE, RMSE and R^2 in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    a = pred.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg((y - p) * (y - p)).alias("mse"),
        F.sum((y - p) * (y - p)).alias("_sse"), F.var_pop(y).alias("_vy"))
    return a.select("n", "mse", F.sqrt("mse").alias("rmse"),
                    (1 - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("n"))).alias("r2"))


def actual_vs_predicted(pred: DataFrame, label: str = LABEL, prediction: str = PREDICTION,
                        max_points: int | None = None, seed: int = 42) -> tuple[DataFrame, tuple]:
    """(actual, predicted) pairs and the ideal-line ends (min and max of actual)."""
    from framewise.operators.charts import sample_rows
    pts = pred.select(F.col(label).alias("actual"), F.col(prediction).alias("predicted"))
    lo, hi = pts.agg(F.min("actual"), F.max("actual")).first()
    return sample_rows(pts, max_points, seed), (lo, hi)


def classification_report(pred: DataFrame, actual: str = LABEL, predicted: str = PREDICTION) -> DataFrame:
    """Per-class precision, recall, F1 and support, plus accuracy and the
    macro and weighted averages, all derived from one (actual, predicted) count.
    A zero denominator gives 0."""
    pairs = (pred.select(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p"))
             .groupBy("a", "p").agg(F.count(F.lit(1)).alias("n")))
    # the pair table has at most classes^2 rows: it is small by construction
    tp = pairs.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"),
                                F.sum("n").alias("support"))
    pc = pairs.groupBy(F.col("p").alias("a")).agg(F.sum("n").alias("predicted"))
    per = tp.join(pc, "a", "full").select(
        F.col("a").alias("class"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("predicted", F.lit(0)).alias("npred"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                       F.col("precision") + F.col("recall")), F.lit(0.0)))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp_all"), F.count(F.lit(1)).alias("k"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                  F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                  F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    rows = per.select("class", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    acc = F.try_divide(F.col("tp_all").cast("double"), F.col("n").cast("double"))
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").cast("long").alias("support")))))
    return rows.unionByName(summary)


def confusion_matrix(pred: DataFrame, actual: str = LABEL, predicted: str = PREDICTION,
                     wide: bool = False) -> DataFrame:
    """Counts per (actual, predicted); ``wide=True`` pivots predicted labels to columns."""
    long = (pred.select(F.col(actual).cast("string").alias("actual"),
                        F.col(predicted).cast("string").alias("predicted"))
            .groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count")))
    if not wide:
        return long.orderBy("actual", "predicted")
    return long.groupBy("actual").pivot("predicted").agg(F.first("count")).na.fill(0).orderBy("actual")


# --------------------------------------------------------------- A12, M17
def save_model(bundle: ModelBundle, path: str) -> None:
    """Pipeline (encoders, imputation, scaler, model, decoder) + JSON sidecar."""
    bundle.model.write().overwrite().save(os.path.join(path, "pipeline"))
    meta = {"kind": bundle.kind, "problem_type": bundle.problem_type, "features": bundle.features,
            "target": bundle.target, "classes": bundle.classes, "metrics": bundle.metrics, "info": bundle.info}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "meta"))


def load_model(spark, path: str) -> ModelBundle:
    """Everything saved is restored (the reference drops encoders and scaler)."""
    model = PipelineModel.load(os.path.join(path, "pipeline"))
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    return ModelBundle(model, meta["kind"], meta["problem_type"], meta["features"], meta["target"],
                       meta["classes"], meta["metrics"], meta["info"])


def score(bundle: ModelBundle, df: DataFrame) -> DataFrame:
    """Predict new rows. Unseen or missing text values take the training
    mode; missing numbers take the training mean (through the fitted stages)."""
    info = bundle.info
    fixes = {}
    for c in info.get("text", []):
        mode = info.get("modes", {}).get(c)
        if mode is None or c not in df.columns:
            continue
        # the fitted encoder looks the text up; what it doesn't know has the code after its last label
        encoder = next(m for m in bundle.model.stages if isinstance(m, StringIndexerModel) and m.getInputCol() == c)
        known = f"{c}__known"
        df = encoder.copy({encoder.outputCol: known}).transform(df)
        df = df.withColumn(c, F.when(q(known) < len(encoder.labels), q(c)).otherwise(F.lit(mode))).drop(known)
    for c in bundle.features:
        if c not in df.columns:
            fixes[c] = F.lit(None).cast("string" if c in info.get("text", []) else "double")
    out = bundle.model.transform(df.withColumns(fixes) if fixes else df)
    drop = [c for c in out.columns if c.endswith(("__code", "__num", "__z"))] + [FEATURES]
    return out.drop(*drop)


def linear_coefficients(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """M6 in original units: ordinary least squares with intercept (normal
    equations, solved by Spark ML from one pass of sums). Rows missing any input
    are skipped. Columns: term, coefficient."""
    cols = list(features)
    d = df.select(*[q(c).cast("double").alias(c) for c in cols], q(target).cast("double").alias(LABEL)).dropna()
    va = VectorAssembler(inputCols=cols, outputCol=FEATURES)
    m = LinearRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=0.0, solver="normal").fit(va.transform(d))
    rows = [("intercept", float(m.intercept))] + [(c, float(v)) for c, v in zip(cols, m.coefficients.toArray())]
    return SparkSession.active().createDataFrame(rows, "term string, coefficient double")


def model_report(bundle: ModelBundle) -> DataFrame:
    """Metrics of a trained bundle as rows (metric, value)."""
    rows = []
    if bundle.problem_type == "regression":
        rows = [(k, float(v) if v is not None else None) for k, v in bundle.metrics.items()]
    else:
        for cls, m in bundle.metrics.items():
            for k, v in m.items():
                rows.append((f"{cls}.{k}", float(v) if v is not None else None))
    return SparkSession.active().createDataFrame(rows, "metric string, value double")
