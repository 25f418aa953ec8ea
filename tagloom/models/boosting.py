"""Gradient boosting whose trees each see their own columns and their own rows.

Spark ML's boosting draws columns anew at every split and keeps its rows in one lineage. Here a step is one
``DecisionTreeRegressor`` on what the steps before it leave over; the columns of a tree are drawn once, and a
row takes part by a hash of its ids and the tree's number, so the draw is the same wherever the row lies.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.models.specs import SEED, UNLIMITED_DEPTH
from tagloom.sources.staging import stage

#: Steps after which the rows' margins are written to the shared folder, which ends their lineage.
STEPS_PER_TABLE = 10


def tree_columns(n: int, share: float, tree: int, seed: int = SEED) -> list[int]:
    """The columns of one tree: a share of all, one at least, drawn once for the tree."""
    return sorted(random.Random(seed * 1_000_003 + tree).sample(range(n), max(1, int(share * n))))


def takes_part(share: float, tree: int, order: Sequence[str]) -> Column:
    """Whether a row is in a tree's sample: the first 32 bits of a digest of the tree's number and the row's ids."""
    if share >= 1:
        return F.lit(True)
    if not order:
        raise ValueError("row samples need the ids that tell rows apart")
    drawn = F.md5(F.concat_ws("|", F.lit(tree), *[F.col(c).cast("string") for c in order]).cast("binary"))
    return F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") < int(share * 2**32)


class BoostedTrees:
    """The base value plus ``rate`` times the sum of the trees."""

    def __init__(self, base: float, rate: float, trees: list):
        self.base, self.rate, self.trees = base, rate, trees

    def transform(self, df: DataFrame) -> DataFrame:
        return added(df.withColumn("prediction", F.lit(self.base)), self.trees, self.rate, "prediction")

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802, as Spark ML names it
        total = sum((t.featureImportances.toArray() for t in self.trees), np.zeros(1))
        return Vectors.dense(total / total.sum() if total.sum() else total)


def added(df: DataFrame, trees: Sequence, rate: float, name: str) -> DataFrame:
    """``df`` with the trees' predictions, times ``rate``, added to column ``name``."""
    columns = df.columns
    for k, tree in enumerate(trees):
        df = tree.copy().setPredictionCol(f"_tree{k}").transform(df)
    grown = F.col(name)
    for k in range(len(trees)):
        grown = grown + F.lit(rate) * F.col(f"_tree{k}")
    return df.select(*[grown.alias(name) if c == name else F.col(f"`{c}`") for c in columns])


def fit_boosted(
    train: DataFrame, trees: int, rate: float, depth: int | None = None, rows: float = 1.0, columns: float = 1.0,
    min_leaf: int = 1, bins: int = 32, order: Sequence[str] = (), seed: int = SEED,
) -> BoostedTrees:
    """Fits on assembled rows (``features``, ``label``): squared error, leaves are means of what is left over.

    ``columns`` is the share of columns a tree may split on, ``rows`` the share of rows it is fitted on (then
    ``order`` names the ids). Every tree corrects all rows. Columns left out are constant for the tree's fit, so
    trees keep the columns' numbers. Without rows or labels the model predicts null.
    """
    base = train.agg(F.avg("label")).first()[0]
    if base is None:
        return BoostedTrees(None, rate, [])
    left = stage(train.select(*order, "features", "label").withColumn("margin", F.lit(base)))
    width, grown, fresh = len(left.first().features), [], []
    for k in range(trees):
        chosen = tree_columns(width, columns, k, seed)
        mask = Vectors.dense([float(c in chosen) for c in range(width)])
        now = added(left, fresh, rate, "margin").where(takes_part(rows, k, order))
        now = now.select("features", (F.col("label") - F.col("margin")).alias("rest"))
        seen = ElementwiseProduct(scalingVec=mask, inputCol="features", outputCol="seen").transform(now)
        learner = DecisionTreeRegressor(
            featuresCol="seen", labelCol="rest", maxDepth=depth or UNLIMITED_DEPTH, minInstancesPerNode=min_leaf, maxBins=bins, seed=seed
        )
        tree = learner.fit(seen.select("seen", "rest")).setFeaturesCol("features")
        grown.append(tree), fresh.append(tree)
        if len(fresh) == STEPS_PER_TABLE and k + 1 < trees:
            left, fresh = stage(added(left, fresh, rate, "margin")), []
    return BoostedTrees(base, rate, grown)
