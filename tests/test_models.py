import json
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.models import experiments as ex, fit
from tagloom.models.specs import SPECS, TUNING_GRID, Spec
from tagloom.operators.metrics import regression_metrics
from tagloom.operators.order import expanding_folds, time_split

FEATURES = ["x0", "x1", "x2"]
FOREST = Spec("forest", "random_forest", {"trees": 8, "depth": 5})
BOOST = Spec("boost", "gradient_boosting", {"trees": 8, "depth": 3, "rate": 0.3})


@pytest.fixture(scope="module")
def raw():
    rnd = random.Random(3)
    out = []
    for i in range(120):
        x = [rnd.gauss(0, 1) for _ in FEATURES]
        out.append((i, *x, 3 * x[0] - 2 * x[1] + 5 + rnd.gauss(0, 0.1)))
    return out


@pytest.fixture(scope="module")
def split(spark, raw):
    df = spark.createDataFrame(raw, "id long, x0 double, x1 double, x2 double, y double")
    return time_split(df, None, 0.2, id_cols=["id"]).cache()


def linear_solution(raw, alpha):
    train = np.array([r[1:] for r in raw[:96]])
    x, y = train[:, :3] - train[:, :3].mean(0), train[:, 3] - train[:, 3].mean()
    return np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ y)


@pytest.mark.parametrize("alpha", [1.0, 50.0])
def test_ridge_is_the_closed_form(split, raw, alpha):
    data = ex.prepare(split, FEATURES, "y").where("part = 'train'")
    model = fit.fit_model(data, Spec("r", "ridge", {"alpha": alpha}))
    assert model.coefficients.toArray() == pytest.approx(linear_solution(raw, alpha), abs=1e-10)


def test_elastic_net_meets_its_optimality_conditions(split, raw):
    alpha, ratio = 0.5, 0.6
    data = ex.prepare(split, FEATURES, "y").where("part = 'train'")
    model = fit.fit_model(data, Spec("e", "elasticnet", {"alpha": alpha, "l1_ratio": ratio}))
    w = model.coefficients.toArray()
    train = np.array([r[1:] for r in raw[:96]])
    x, y = train[:, :3] - train[:, :3].mean(0), train[:, 3] - train[:, 3].mean()
    slope = x.T @ (y - x @ w) / len(y) - alpha * (1 - ratio) * w
    for g, v in zip(slope, w):
        if v == 0:
            assert abs(g) <= alpha * ratio + 1e-6
        else:
            assert g == pytest.approx(alpha * ratio * np.sign(v), abs=1e-5)


def test_trees_beat_the_mean_and_repeat(split):
    specs = [FOREST, BOOST, SPECS["naive_mean"], SPECS["ridge"]]
    fitted = {}
    a = ex.run_grid(split, FEATURES, "y", specs, ["id"], fitted=fitted)
    b = ex.run_grid(split, FEATURES, "y", specs, ["id"], parallel=1)
    assert rows(a) == rows(b) and set(fitted) == {s.name for s in specs}
    r2 = {r.run: r.r2 for r in a.collect()}
    assert r2["ridge"] > 0.99 and min(r2["forest"], r2["boost"]) > 0.5 > r2["naive_mean"]
    params = {r.run: json.loads(r.params) for r in a.collect()}
    assert params["forest"] == FOREST.params
    ranked = fit.importance(split.sparkSession, fitted["forest"], FEATURES).collect()
    assert [r.feature for r in ranked] == ["x0", "x1", "x2"] and ranked[0]["rank"] == 1


def test_predictions_keep_their_rows(split):
    got = ex.fit_predict(split, FEATURES, "y", SPECS["ridge"], ["id"], ["id"])
    truth = dict(rows(split.where("part = 'test'"), "id", "y"))
    assert dict(rows(got, "id", "y_true")) == truth


def test_select_and_refit(split):
    got = ex.select_and_refit(split, FEATURES, "y", [1, 2, 9], FOREST, order=["id"])
    by = {r.variant: r for r in got.collect()}
    assert {v: r.n_features for v, r in by.items()} == {"base_full": 3, "top_1": 1, "top_2": 2, "top_9": 3}
    assert by["base_full"].delta_rmse == 0 and by["base_full"].not_worse and by["top_1"].delta_rmse > 0


@pytest.mark.parametrize("reselect", [None, 2])
def test_walk_forward(split, reselect):
    folds = expanding_folds(split.drop("part").withColumn("t", F.col("id").cast("int")), 3, "t", ["id"])
    predictions, metrics = ex.walk_forward(folds, FEATURES, "y", FOREST, 3, reselect, ["id"], ["id"])
    got = {r.fold: (r.train_size, r.test_size, r.reselected) for r in metrics.collect()}
    assert got == {k: (30 * k, 30, reselect is not None) for k in (1, 2, 3)}
    assert sorted(r.id for r in predictions.collect()) == list(range(30, 120))


def test_transfer(spark, split):
    wanted = spark.createDataFrame([(1, "x1"), (2, "absent"), (3, "x0")], "pos int, feature string")
    predictions, metrics = ex.transfer(split.drop("part"), wanted, "y", SPECS["ridge"], "id", [])
    r = metrics.first()
    assert (r.n_requested_features, r.n_found_features, r.n_missing_features, r.n) == (3, 2, 1, 24)
    assert predictions.count() == 24
    with pytest.raises(ValueError):
        ex.transfer(split, wanted.where("pos = 2"), "y", SPECS["ridge"], "id", [])


def test_targets_and_ablation(split):
    two = split.withColumn("z", -F.col("x2"))
    metrics, best = ex.compare_targets(two, ["y", "z"], FEATURES, [SPECS["naive_mean"], SPECS["ridge"]], ["id"])
    assert metrics.count() == 4 and rows(best, "target", "run") == [("y", "ridge"), ("z", "ridge")]
    runs = ex.ablation(split, FEATURES, "y", [SPECS["ridge"]], {"all": [], "no_x0": ["x0", "absent"]}, ["id"])
    r2 = {r.variant: (r.n_features, r.r2) for r in runs.collect()}
    assert r2["all"][0] == 3 and r2["no_x0"][0] == 2 and r2["all"][1] > r2["no_x0"][1]


def test_baselines(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, "train"), (2, "a", 3.0, "train"), (3, "a", 9.0, "test"), (4, "b", 5.0, "train"), (5, "b", 6.0, "test")],
        "id int, g string, y double, part string",
    )
    assert rows(fit.naive_mean(df, "y"), "id", "y_pred") == [(3, 3.0), (5, 3.0)]
    assert rows(fit.naive_mean(df, "y", ["g"]), "id", "y_pred") == [(3, 2.0), (5, 5.0)]
    last = fit.persistence(df, "y", ["id"], ["g"])
    assert rows(last, "id", "y_pred") == [(1, None), (2, 1.0), (3, 3.0), (4, None), (5, 5.0)]
    assert regression_metrics(last).first().n == 3


def test_specs():
    assert all(k == s.name for k, s in SPECS.items()) and set(TUNING_GRID) <= set(SPECS)
    assert SPECS["rf_v6"].params == {"trees": 300, "depth": 10, "min_leaf": 3}
    with pytest.raises(ValueError):
        fit.fit_model(None, Spec("x", "unknown"))


def test_forests_side_by_side(spark, split):
    """One partition or many: as many trees, predictions are means over them, importances add to one."""
    one = ex.prepare(split, FEATURES, "y", ["id"]).where("part = 'train'")
    grown = fit.fit_model(one, Spec("f", "random_forest", {"trees": 11, "depth": 3}))
    assert isinstance(grown, fit.Forests) and len(grown.trees) == 11 and sum(grown.featureImportances) == pytest.approx(1)
    parts = [f.transform(one).select("id", "prediction") for f in grown.forests]
    want = {i: 0.0 for i, _ in rows(parts[0])}
    for f, part in zip(grown.forests, parts):
        for i, v in rows(part):
            want[i] += v * f.getNumTrees / 11
    assert dict(rows(grown.transform(one), "id", "prediction")) == pytest.approx(want)
    many = fit.fit_model(one.repartition(3), Spec("f", "random_forest", {"trees": 11, "depth": 3}))
    assert not isinstance(many, fit.Forests) and len(many.trees) == 11
