import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tagloom.models import boosting
from tagloom.models.boosting import fit_boosted, takes_part, tree_columns
from tagloom.models.experiments import run_grid
from tagloom.models.fit import fit_model
from tagloom.models.specs import SPECS, Spec
from tagloom.operators.order import time_split


def some_rows(spark, n=300):
    rnd = random.Random(1)
    out = []
    for i in range(n):
        x = [float(rnd.randrange(6)) for _ in range(3)]
        out.append((i, Vectors.dense(x), 4.0 * (x[0] > 2) + 1.5 * x[1] + rnd.gauss(0, 0.2)))
    return spark.createDataFrame(out, ["id", "features", "label"])


def by_hand(rows, trees, rate, share, columns, parts):
    """Depth-one boosting with the same columns and rows per tree, all splits tried."""
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])
    margin = np.full(len(y), y.mean())
    for k in range(trees):
        rest, inside, best = y - margin, parts[k], None
        for c in tree_columns(x.shape[1], columns, k):
            values = np.unique(x[inside, c])
            for bar in (values[1:] + values[:-1]) / 2:
                low = x[:, c] <= bar
                a, b = rest[inside & low], rest[inside & ~low]
                gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b)
                if best is None or gain > best[0]:
                    best = gain, low, a.mean(), b.mean()
        margin = margin + rate * np.where(best[1], best[2], best[3])
    return margin


@pytest.mark.parametrize("rows,columns,steps", [(1.0, 1.0, 10), (0.7, 0.7, 2)])
def test_stumps(spark, monkeypatch, rows, columns, steps):
    monkeypatch.setattr(boosting, "STEPS_PER_TABLE", steps)
    df = some_rows(spark).cache()
    every = df.orderBy("id").collect()
    parts = [np.array([r[0] for r in df.orderBy("id").select(takes_part(rows, k, ["id"])).collect()]) for k in range(5)]
    assert all(0.5 < p.mean() <= 1 for p in parts) and (rows == 1 or not (parts[0] == parts[1]).all())
    model = fit_boosted(df, 5, 0.4, depth=1, rows=rows, columns=columns, order=["id"])
    got = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    assert got == pytest.approx(by_hand(every, 5, 0.4, rows, columns, parts).tolist(), abs=1e-9)
    assert sum(model.featureImportances) == pytest.approx(1)


def test_columns_and_rows_are_drawn_once_a_tree(spark):
    assert [len(tree_columns(10, s, 3)) for s in (0.9, 0.05, 1.0)] == [9, 1, 10]
    assert tree_columns(10, 0.5, 1) == tree_columns(10, 0.5, 1) != tree_columns(10, 0.5, 2)
    df = spark.range(20_000)
    one = df.where(takes_part(0.9, 4, ["id"]))
    assert 0.88 < one.count() / 20_000 < 0.92
    again = df.repartition(7).where(takes_part(0.9, 4, ["id"]))
    assert one.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        takes_part(0.9, 0, [])


def test_in_a_grid(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.random(), rnd.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("y", F.col("a") * 3 + F.when(F.col("b") > 0.5, 2.0).otherwise(0.0))
    spec = Spec("small", "boosted_trees", {"trees": 12, "depth": 3, "rate": 0.3, "rows": 0.9, "columns": 0.9})
    split = time_split(df, None, 0.2, id_cols=["id"])
    r2 = {r.run: r.r2 for r in run_grid(split, ["a", "b"], "y", [spec, SPECS["naive_mean"]], ["id"]).collect()}
    assert r2["small"] > 0.7 > r2["naive_mean"]
    assert SPECS["xgb_small"].params == {"trees": 200, "depth": 4, "rate": 0.05, "rows": 0.9, "columns": 0.9}


def test_without_rows(spark):
    df = some_rows(spark, 4)
    assert [r.prediction for r in fit_model(df.limit(0), Spec("b", "boosted_trees", {"trees": 2, "rate": 0.1})).transform(df).collect()] == [None] * 4
    flat = df.withColumn("label", F.lit(3.0))
    assert [r.prediction for r in fit_boosted(flat, 2, 0.1, depth=2).transform(flat).collect()] == [3.0] * 4
