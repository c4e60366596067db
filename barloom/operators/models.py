"""Spark ML estimators behind one fit / predict / importance surface.

These fits pool whatever rows they are given: one symbol, a basket, or the
whole panel.  Linear models per symbol (or per fold) for any number of symbols
at once are in :mod:`barloom.operators.linear`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.durable import ensure_checkpoint_dir

#: Default settings per model family.
DEFAULTS: dict[str, dict[str, Any]] = {
    "linear": {},
    "ridge": {"alpha": 1.0},
    "random_forest": {"trees": 300, "depth": 5, "min_leaf": 50, "feature_share": 0.5},
    "boosted": {
        "rounds": 300,
        "depth": 3,
        "learning_rate": 0.03,
        "row_share": 0.8,
        "feature_share": 0.8,
        "min_leaf": 20,
    },
}
MODELS = tuple(DEFAULTS)
TASKS = ("regression", "classification")


_IO = {"featuresCol": "scaled", "labelCol": "target"}


def _alpha(p: Mapping[str, Any], n: int) -> float:
    """A penalty on a sum of squares for inputs that Spark scales by the sample deviation."""
    alpha = p.get("alpha", 1.0)
    return alpha * (n - 1) / n if n > 1 else alpha


def _least_squares(p, seed, n, label_sd):
    penalty = _alpha(p, n) * label_sd / n if "alpha" in p else 0.0
    return LinearRegression(regParam=penalty, elasticNetParam=0.0, solver="normal", standardization=False, **_IO)


def _logistic(p, seed, n, label_sd):
    return LogisticRegression(
        regParam=max(_alpha(p, n), 1e-9) / n, maxIter=1000, tol=1e-8, standardization=False, **_IO
    )


def _grown(cls, own: Mapping[str, str]):
    """Trees of a class; ``own`` maps its Spark parameters to our settings."""

    def make(p, seed, n, label_sd):
        return cls(
            seed=seed, maxDepth=p["depth"], minInstancesPerNode=p["min_leaf"],
            featureSubsetStrategy=str(p["feature_share"]), **{k: p[v] for k, v in own.items()}, **_IO,
        )

    return make


_FOREST = {"numTrees": "trees"}
_STEPS = {"maxIter": "rounds", "stepSize": "learning_rate", "subsamplingRate": "row_share"}

#: Who makes the estimator of a model and a task.
FACTORIES = {
    ("linear", "regression"): _least_squares,
    ("ridge", "regression"): _least_squares,
    ("linear", "classification"): _logistic,
    ("ridge", "classification"): _logistic,
    ("random_forest", "regression"): _grown(RandomForestRegressor, _FOREST),
    ("random_forest", "classification"): _grown(RandomForestClassifier, _FOREST),
    ("boosted", "regression"): _grown(GBTRegressor, _STEPS),
    ("boosted", "classification"): _grown(GBTClassifier, _STEPS),
}


def build_model(
    name: str,
    params: Mapping[str, Any] | None = None,
    seed: int = 42,
    task: str = "regression",
    n: int = 1,
    label_sd: float = 1.0,
):
    """The bare estimator.

    ``n`` and ``label_sd`` (population standard deviation of the label) turn a
    penalty on a sum of squares, alpha, into the per-row penalty Spark takes.
    Boosted trees have no leaf penalty in Spark ML.
    """
    make = FACTORIES.get((name, task))
    if make is None:
        raise ValueError(f"no model {name!r} for {task!r}; models {MODELS}, tasks {TASKS}")
    return make({**DEFAULTS[name], **(params or {})}, seed, n, label_sd)


def fit_model(
    train: DataFrame,
    features: Sequence[str],
    name: str = "boosted",
    params: Mapping[str, Any] | None = None,
    seed: int = 42,
    task: str = "regression",
) -> PipelineModel:
    """Assemble, scale and fit on exactly the rows given (the training part).

    A missing feature is an error, not a silently dropped row.
    """
    facts = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("target").alias("labelled"),
        F.stddev_pop("target").alias("sd"),
    ).first()
    if facts["n"] == 0:
        raise ValueError("cannot fit on an empty training set")
    if facts["labelled"] != facts["n"]:
        raise ValueError("training rows without a target")
    estimator = build_model(name, params, seed, task, facts["n"], facts["sd"] or 1.0)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="error"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
            estimator,
        ]
    ).fit(train.select(*features, "target"))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction`` (and ``probability`` of the upper class).

    Features are picked by name, so column order does not matter; an absent
    one raises.
    """
    lacking = set(model.stages[0].getInputCols()) - set(df.columns)
    if lacking:
        raise ValueError(f"missing feature columns: {sorted(lacking)}")
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability")[1])
    return out.drop("raw", "scaled", "rawPrediction")


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance), normalised to sum to 1; one row per model input."""
    names, fitted = model.stages[0].getInputCols(), model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        weights = fitted.featureImportances.toArray()
    else:
        weights = abs(fitted.coefficients.toArray())
    total = float(weights.sum())
    scaled = weights / total if total > 0 else weights
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(names, scaled)], "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")


def logistic_slopes(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``(feature, n, slope)`` of the penalised mean log loss at a logistic model's weights.

    One pass over the rows; a fit that has converged on them has slopes near
    zero.  The intercept carries no penalty.
    """
    names, fitted = model.stages[0].getInputCols(), model.stages[-1]
    scored = model.transform(df).select(
        vector_to_array("scaled").alias("z"), (vector_to_array("probability")[1] - F.col("target")).alias("off")
    )
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg("off").alias("s"),
        *[F.avg(F.col("z")[i] * F.col("off")).alias(f"s{i}") for i in range(len(names))],
    )
    penalty = fitted.getRegParam()
    slopes = [F.struct(F.lit("intercept").alias("feature"), F.col("s").alias("slope"))] + [
        F.struct(F.lit(c).alias("feature"), (F.col(f"s{i}") + penalty * float(w)).alias("slope"))
        for i, (c, w) in enumerate(zip(names, fitted.coefficients.toArray()))
    ]
    return sums.select("n", F.explode(F.array(*slopes)).alias("g")).select("g.feature", "n", "g.slope")


def tree_nodes(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """The trees of a fitted forest or boosted regressor as a table, one row per node.

    ``tree, node, feature, threshold, low, high, value, weight``: rows whose
    scaled input ``feature`` is at most ``threshold`` go on to ``low``, others
    to ``high``; a leaf has no feature and gives ``value``, which counts with
    the tree's ``weight``.
    """
    fitted = model.stages[-1]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    fitted.write().save(path)
    weights = list(fitted.treeWeights)
    if isinstance(fitted, RandomForestRegressionModel):
        weights = [w / sum(weights) for w in weights]
    leaf = F.col("n.leftChild") < 0
    return spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), F.col("nodeData").alias("n")).select(
        "tree",
        F.col("n.id").alias("node"),
        F.when(~leaf, F.col("n.split.featureIndex")).alias("feature"),
        F.when(~leaf, F.get("n.split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.col("n.leftChild").alias("low"),
        F.col("n.rightChild").alias("high"),
        F.col("n.prediction").alias("value"),
        F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("tree")).alias("weight"),
    )


def score_nodes(nodes: DataFrame, model: PipelineModel, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, prediction)`` of rows walked down a node table, one join per level of the trees.

    ``keys`` tell rows apart.  Only the inputs' scaling is taken from the model.
    """
    depth, trees = model.stages[-1].getMaxDepth(), model.stages[-1].getNumTrees
    scaled = PipelineModel(model.stages[:-1]).transform(df)
    at = scaled.select(*keys, vector_to_array("scaled").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    at = at.withColumn("node", F.lit(0))
    for _ in range(depth):
        step = F.when(F.col("feature").isNull(), F.col("node")).when(F.get("z", F.col("feature")) <= F.col("threshold"), F.col("low"))
        at = at.join(nodes, ["tree", "node"]).select(*keys, "z", "tree", step.otherwise(F.col("high")).alias("node"))
    ends = at.join(nodes, ["tree", "node"])
    return ends.groupBy(*keys).agg(F.sum(F.col("value") * F.col("weight")).alias("prediction"))


def model_path(root: str, scope: str, name: str, fingerprint: str) -> str:
    return f"{root.rstrip('/')}/{scope}_{name}_{fingerprint}"


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """The stored model.  Nothing is ever retrained when it is absent."""
    return PipelineModel.load(path)


def fit_many(
    jobs: Mapping[Any, Callable[[], PipelineModel]], parallel: int = 4
) -> dict[Any, PipelineModel]:
    """Run independent fits side by side; each is a Spark job of its own."""
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        running = {k: pool.submit(job) for k, job in jobs.items()}
        return {k: f.result() for k, f in running.items()}


def stack_predictions(
    models: Mapping[Any, PipelineModel], df: DataFrame, label: str
) -> DataFrame:
    """Predictions of several models on the same rows, told apart by ``label``."""
    out = None
    for key, model in models.items():
        part = predict(model, df).withColumn(label, F.lit(key))
        out = part if out is None else out.unionByName(part)
    return out


def fit_basket(
    train: DataFrame, features: Sequence[str], symbols: Sequence[str], parallel: int = 4, **options
) -> dict[str, PipelineModel]:
    """One model per named symbol.

    The panel is scanned once: it is written to the shared checkpoint folder by
    symbol, and each fit reads the folder of its own symbol.
    """
    spark = train.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/basket-{uuid.uuid4().hex}"
    rows = train.where(F.col("symbol").isin(list(symbols))).select("symbol", "date", *features, "target")
    rows.repartition("symbol").write.partitionBy("symbol").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return fit_many(
        {s: (lambda s=s: fit_model(stored.where(F.col("symbol") == s), features, **options)) for s in symbols},
        parallel,
    )


def predict_basket(models: Mapping[str, PipelineModel], df: DataFrame) -> DataFrame:
    """Each symbol's rows under its own model."""
    out = None
    for symbol, model in models.items():
        part = predict(model, df.where(F.col("symbol") == symbol))
        out = part if out is None else out.unionByName(part)
    return out
