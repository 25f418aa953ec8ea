import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.models import experiments as ex
from tagloom.models.fit import fit_model, predict
from tagloom.models.slices import SLICE, cross_products, slices_of
from tagloom.models.specs import SPECS, Spec
from tagloom.operators.order import expanding_folds

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def folds(spark):
    rnd, out = random.Random(2), []
    for i in range(90):
        a, b = 1e6 + rnd.gauss(0, 3), rnd.gauss(0, 1)
        a = None if i % 7 == 3 else float("nan") if i % 11 == 5 else a
        c = None if i < 40 else rnd.gauss(5, 2)  # no value before the second fold
        y = None if i % 13 == 12 else 2 * b + (a if a and a == a else 1e6) / 3 + rnd.gauss(0, 0.1)
        out.append((i, a, b, c, y))
    df = spark.createDataFrame(out, "id int, a double, b double, c double, y double")
    return expanding_folds(df, 4, "id").cache()


def fold_by_fold(folds, spec):
    """The same folds, each imputed and fitted on its own."""
    out = []
    for k in range(1, 5):
        data = ex.prepare(folds.where(F.col("fold") == k).withColumnRenamed("role", "part"), FEATURES, "y", ["id"])
        model = fit_model(data.where("part = 'train'"), spec, ["id"])
        out += predict(model, data.where("part = 'test'"), ["fold", "id"]).collect()
    return sorted((r.fold, r.id, r.y_true, r.y_pred) for r in out)


@pytest.mark.parametrize("spec", [SPECS["ridge"], SPECS["naive_mean"], Spec("e", "elasticnet", {"alpha": 0.05, "l1_ratio": 0.5})], ids=lambda s: s.model)
def test_same_as_fold_by_fold(folds, spec):
    predictions, metrics = ex.walk_forward(folds, FEATURES, "y", spec, 4, keep=["id"])
    want = fold_by_fold(folds, spec)
    got = sorted((r.fold, r.id, r.y_true, r.y_pred) for r in predictions.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-8 if spec.model != "elasticnet" else 1e-6)
    labelled = sorted(r.id for r in folds.where("fold = 4 AND y IS NOT NULL").collect())
    sizes = {r.fold: (r.train_size, r.test_size) for r in metrics.collect()}
    assert sizes == {k: (sum(i < 18 * k for i in labelled), sum(18 * k <= i < 18 * k + 18 for i in labelled)) for k in range(1, 5)}


def test_cross_products(folds):
    once = slices_of(folds, 4)
    assert once.count() == 90 and dict(rows(once.groupBy(SLICE).count())) == {k: 18 for k in range(5)}
    made = cross_products(once.repartition(5), FEATURES, "y", 4)
    assert made.rows.tolist() == [18] * 5
    table = np.array([[np.nan if v is None else v for v in r] for r in once.where("y IS NOT NULL").select(*FEATURES, "y", SLICE).collect()], float)
    medians = np.array([7.0, 8.0, 9.0])
    for k in range(1, 5):
        x = table[table[:, 4] < k]
        x = np.concatenate([np.where(np.isnan(x[:, :3]), medians, x[:, :3]) - made.shift[:3], np.ones((len(x), 1)), x[:, 3:4] - made.shift[3]], axis=1)
        assert made.filled(k, medians) == pytest.approx(x.T @ x, rel=1e-9, abs=1e-6)


def test_one_scan(spark, folds, tmp_path):
    """All folds of a linear model are fitted from one job's pass over the rows, and predicted by one more."""
    path = str(tmp_path / "rows")
    slices_of(folds, 4).write.parquet(path)
    once = spark.read.parquet(path)
    predictions, _ = ex._linear_folds(once.drop("c").withColumn("c", F.col("b")), ["b", "c"], "y", SPECS["ridge"], 4, [])
    assert predictions._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_too_few_rows_and_no_labels(spark, folds):
    with pytest.raises(ValueError):
        ex.walk_forward(folds.where("id > 80"), FEATURES, "y", SPECS["ridge"], 4)
    late = folds.withColumn("y", F.when(F.col("id") >= 36, F.col("y")))
    predictions, metrics = ex.walk_forward(late, FEATURES, "y", SPECS["ridge"], 4, keep=["id"])
    known = {r.fold: r.y_pred is not None for r in predictions.collect()}
    assert known == {2: False, 3: True, 4: True}
    assert ex.walk_forward(folds, FEATURES, "y", Spec("f", "random_forest", {"trees": 3, "depth": 2}), 4, order=["id"])[1].count() == 4
