"""Linear models of all expanding folds from one pass: cross products of each slice, summed up to every fold.

Fold k trains on the slices before it. The cross products of a slice are added once, and those of a fold's
training rows are the sum over its slices, so no row is read, copied or filtered once a fold. Medians
for missing values differ between folds; a row's missing entries are therefore counted as columns of their own,
from which the cross products with any filling follow.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.models.specs import Spec

SLICE = "_slice"


def slices_of(folds: DataFrame, n_splits: int) -> DataFrame:
    """Every row behind ``expanding_folds`` once, with the slice it lies in (0 only trains) as ``_slice``."""
    once = folds.where((F.col("role") == "test") | ((F.col("fold") == 1) & (F.col("role") == "train")))
    return once.withColumn(SLICE, F.when(F.col("role") == "test", F.col("fold")).otherwise(0).cast("int")).drop("fold", "role")


def finite(name: str) -> Column:
    """A column as doubles, null where it is not finite."""
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


@dataclass
class Products:
    """Cross products of (value, missing, 1, label) by slice; values and label less ``shift``, missing values 0."""

    shift: np.ndarray
    grams: np.ndarray  # slices, columns, columns
    rows: np.ndarray  # all rows of a slice, with or without a label

    def missing(self, to: int) -> np.ndarray:
        """How often each feature is missing in slices up to ``to``."""
        p = len(self.shift) - 1
        return self.grams[: to + 1, 2 * p, p : 2 * p].sum(axis=0)

    def filled(self, k: int, medians: np.ndarray) -> np.ndarray:
        """Cross products of (features, 1, label) over the training rows of fold ``k``, missing values filled."""
        p = len(self.shift) - 1
        turn = np.zeros((2 * p + 2, p + 2))
        turn[:p, :p] = np.eye(p)
        turn[p : 2 * p, :p] = np.diag(medians - self.shift[:p])
        turn[2 * p, p] = turn[2 * p + 1, p + 1] = 1
        return turn.T @ self.grams[:k].sum(axis=0) @ turn


def cross_products(rows: DataFrame, features: Sequence[str], label: str, n_splits: int) -> Products:
    """One pass over ``rows`` (with ``_slice``); what a task finds is added up before and after one shuffle.

    The shuffled and collected numbers are (2 * features + 2) squared for each slice, whatever the rows. Values
    are shifted by those of some labelled row, which keeps the sums exact enough for columns far from zero.
    """
    values = rows.select(SLICE, *[finite(c).alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"))
    some = values.where(F.col("y").isNotNull()).first()
    shift = np.array([v or 0.0 for v in (some[1:] if some else [0.0] * (len(features) + 1))])
    p, schema = len(features), pa.schema([("slice", pa.int32()), ("cell", pa.int64()), ("total", pa.float64())])
    size = 2 * p + 2

    def add(batches):
        sums, counts = np.zeros((n_splits + 1, size, size)), np.zeros(n_splits + 1)
        for b in batches:
            where = np.asarray(b.column(0))
            counts += np.bincount(where, minlength=n_splits + 1)
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1).astype(np.float64)
            known = ~np.isnan(x[:, p])
            x, where = x[known] - shift, where[known]
            gaps = np.isnan(x[:, :p])
            v = np.concatenate([np.where(gaps, 0.0, x[:, :p]), gaps, np.ones((len(x), 1)), x[:, p:]], axis=1)
            for s in np.unique(where):
                part = v[where == s]
                sums[s] += part.T @ part
        for s in np.flatnonzero(counts):
            cells = np.append(sums[s].ravel(), counts[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), s), pa.int32()), pa.array(np.arange(len(cells))), pa.array(cells)], schema=schema)

    added = values.mapInArrow(add, "slice int, cell long, total double").groupBy("slice", "cell").agg(F.sum("total").alias("total"))
    cells = np.zeros((n_splits + 1, size * size + 1))
    for r in added.collect():
        cells[r["slice"], r.cell] = r.total
    return Products(shift, cells[:, :-1].reshape(-1, size, size), cells[:, -1])


def solve(gram: np.ndarray, spec: Spec) -> tuple[np.ndarray, float] | None:
    """(weights, intercept) from cross products of (features, 1, label); none without rows."""
    p, n = len(gram) - 2, gram[-2, -2]
    if not n:
        return None
    means, mean = gram[:p, p] / n, gram[p, -1] / n
    sxx = gram[:p, :p] - n * np.outer(means, means)
    sxy = gram[:p, -1] - n * means * mean
    if spec.model == "naive_mean":
        weights = np.zeros(p)
    elif spec.model == "ridge":
        weights = np.linalg.lstsq(sxx + spec.params["alpha"] * np.eye(p), sxy, rcond=None)[0]
    elif spec.model == "elasticnet":
        weights = _elastic_net(sxx / n, sxy / n, spec.params["alpha"], spec.params["l1_ratio"])
    else:
        raise ValueError(f"{spec.model!r} does not follow from cross products")
    return weights, float(mean - means @ weights)


def _elastic_net(sxx: np.ndarray, sxy: np.ndarray, alpha: float, ratio: float, rounds: int = 100_000) -> np.ndarray:
    """Coordinate descent on half the mean squared error plus the two penalties."""
    w, l1, l2 = np.zeros(len(sxy)), alpha * ratio, alpha * (1 - ratio)
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            pull = sxy[j] - sxx[j] @ w + sxx[j, j] * w[j]
            scale = sxx[j, j] + l2
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / scale if scale > 0 else 0.0
            most = max(most, abs(new - w[j]))
            w[j] = new
        if most <= 1e-13 * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def fold_predictions(
    rows: DataFrame, features: Sequence[str], label: str, fitted: list, medians: list[np.ndarray], shift: np.ndarray, keep: Sequence[str]
) -> DataFrame:
    """Test rows of all folds with the prediction of their own fold's model: fold, ``keep``, y_true, y_pred."""
    fold = F.col(SLICE)

    def by_fold(values) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("double") for v in values]), fold)

    def start(f) -> float | None:
        return None if f is None else float(shift[-1] + f[1] - f[0] @ shift[:-1])

    guess = by_fold([start(f) for f in fitted])
    for j, name in enumerate(features):
        weight = by_fold([0.0 if f is None else float(f[0][j]) for f in fitted])
        guess = guess + weight * F.coalesce(finite(name), by_fold([float(m[j]) for m in medians]))
    test = rows.where((fold > 0) & F.col(label).isNotNull())
    return test.select(fold.alias("fold"), *keep, F.col(label).cast("double").alias("y_true"), guess.alias("y_pred"))
