"""Fitting and predicting with Spark ML, plus the two naive baselines."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.models.boosting import fit_boosted
from tagloom.models.specs import SEED, UNLIMITED_DEPTH, Spec
from tagloom.operators.ranks import over_series
from tagloom.sources.staging import shared_folder

PARTITION_BYTES = 64_000_000  # of feature values in a partition
FOREST_PARTS = 8  # forests that grow side by side when the rows are one partition


class NaiveMean:
    """Predicts the mean of the training label."""

    def __init__(self, mean: float | None):
        self.mean = mean

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.mean).cast("double"))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame([(self.mean,)], "mean double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> NaiveMean:
        return cls(SparkSession.active().read.parquet(path).first()[0])


def assemble(
    df: DataFrame, features: Sequence[str], label: str, order: Sequence[str] = ()
) -> DataFrame:
    """Add the ``features`` vector and a double ``label``; rows without a label are dropped.

    With ``order`` (unique ids) rows are laid out the same way on every run, so that a seed always
    draws the same samples whatever the session's settings. Tree learners keep statistics of all
    open nodes per partition, so there is one partition for every ``PARTITION_BYTES`` of values.
    """
    rows = df.where(F.col(label).isNotNull())
    if order:
        parts = max(1, math.ceil(rows.count() * 8 * (len(features) + 1) / PARTITION_BYTES))
        rows = rows.repartition(parts, *order).sortWithinPartitions(*order)
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return vector.transform(rows.withColumn("label", F.col(label).cast("double")))


def _tree_params(p: dict) -> dict:
    return {
        "maxDepth": p.get("depth") or UNLIMITED_DEPTH,
        "minInstancesPerNode": p.get("min_leaf", 1),
        "featureSubsetStrategy": p.get("features", "all"),
        "subsamplingRate": p.get("rows", 1.0),
        "maxBins": p.get("bins", 32),
        "seed": SEED,
    }


class Forests:
    """Forests grown side by side on the same rows; a prediction is the mean over all their trees."""

    def __init__(self, forests: list):
        self.forests = forests
        self.trees = [t for f in forests for t in f.trees]

    def transform(self, df: DataFrame) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in df.columns]
        for k, forest in enumerate(self.forests):
            df = forest.copy().setPredictionCol(f"_forest{k}").transform(df)
        total = reduce(lambda a, b: a + b, [F.col(f"_forest{k}") * f.getNumTrees for k, f in enumerate(self.forests)])
        return df.select(*columns, (total / len(self.trees)).alias("prediction"))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802, as Spark ML names it
        total = sum(f.featureImportances.toArray() * f.getNumTrees for f in self.forests)
        return Vectors.dense(total / total.sum() if total.sum() else total)


def _forest(train: DataFrame, p: dict):
    """One forest, or on rows of a single partition several smaller ones at a time, as one task would grow all trees.

    Which it is depends on the rows alone, so a seed draws the same samples everywhere.
    """
    parts = min(FOREST_PARTS, p["trees"]) if train.rdd.getNumPartitions() == 1 else 1
    shared = _tree_params(p) | {"bootstrap": p.get("bootstrap", True)}

    def grow(k: int):
        trees = p["trees"] // parts + (k < p["trees"] % parts)
        return RandomForestRegressor(numTrees=trees, **shared | {"seed": SEED + k}).fit(train)

    if parts == 1:
        return grow(0)
    with ThreadPool(parts) as pool:
        return Forests(pool.map(inheritable_thread_target(train.sparkSession)(grow), range(parts)))


def fit_model(train: DataFrame, spec: Spec, order: Sequence[str] = ()):
    """Fit one configuration on assembled training rows; ``order`` names their ids, which row samples need."""
    p = spec.params
    if spec.model == "random_forest":
        return _forest(train, p)
    if spec.model == "gradient_boosting":
        spark = train.sparkSession
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        gbt = GBTRegressor(maxIter=p["trees"], stepSize=p["rate"], **_tree_params(p))
        return gbt.fit(train)
    if spec.model == "boosted_trees":
        return fit_boosted(train, **p, order=order)
    if spec.model in ("ridge", "elasticnet"):
        n, spread = train.agg(F.count("label"), F.stddev_pop("label")).first()
        if spec.model == "ridge":
            # Spark scales the L2 term by the label's deviation and by the row count.
            l1, l2 = 0.0, p["alpha"] / n * (spread or 1.0)
        else:
            l1 = p["alpha"] * p["l1_ratio"]
            l2 = p["alpha"] * (1 - p["l1_ratio"]) * (spread or 1.0)
        penalty = l1 + l2
        linear = LinearRegression(
            solver="normal",
            tol=1e-12,
            maxIter=1000,
            standardization=False,
            regParam=penalty,
            elasticNetParam=l1 / penalty if penalty else 0.0,
        )
        return linear.fit(train)
    if spec.model == "naive_mean":
        return NaiveMean(train.agg(F.avg("label")).first()[0])
    raise ValueError(f"unknown model {spec.model!r}")


def predict(model, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, ``y_true`` and ``y_pred``; truth stays on its row."""
    return model.transform(rows).select(
        *keep, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")
    )


def importance(spark, model, features: Sequence[str]) -> DataFrame:
    """Feature importances, highest first, with rank (as many rows as features)."""
    scored = zip(features, model.featureImportances.toArray().tolist())
    ranked = sorted(scored, key=lambda fi: (-fi[1], fi[0]))
    rows = [(f, v, i) for i, (f, v) in enumerate(ranked, start=1)]
    return spark.createDataFrame(rows, "feature string, importance double, rank long")


def params_json(spec: Spec) -> str:
    return json.dumps(spec.params, ensure_ascii=False, sort_keys=True)


def naive_mean(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Test rows with the mean of their group's training label as ``y_pred``.

    Rows without a group (null) are a group; a group without training rows predicts null.
    """
    means = df.groupBy(*group).agg(
        F.avg(F.when(F.col("part") == "train", F.col(label))).alias("y_pred")
    )
    test = df.where("part = 'test'")
    if group:
        # One row per group; the planner broadcasts it when it is small and splits skewed groups when not.
        named = means.select(F.col("y_pred"), *[F.col(g).alias(f"_{g}") for g in group])
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
        found = test.join(named, same, "left").drop(*[f"_{g}" for g in group])
        return found.withColumn("y_true", F.col(label))
    [mean] = means.first()
    return test.withColumns({"y_true": F.col(label), "y_pred": F.lit(mean)})


def persistence(
    df: DataFrame, label: str, order: list[str], partition: Sequence[str] = (), **limits
) -> DataFrame:
    """Every row with the previous known value of its series as ``y_pred``."""

    def build(w):
        return {"y_pred": F.lag(label, 1).over(w)}

    rows = over_series(df, list(partition), order, build, lookback=1, **limits)
    return rows.withColumn("y_true", F.col(label))
