import pytest
from conftest import rows

from tagloom.models import experiments as ex, runs
from tagloom.models.specs import SPECS, Spec

COLUMNS = "id long, x double, z double, y double, part string"
LINEAR = [SPECS["ridge"], SPECS["naive_mean"]]
METRICS = ("run", "model", "params", "pos", "n", "mae", "rmse", "r2")


def make(spark, data):
    return spark.createDataFrame(data, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def data():
    return [(i, float(i % 7), float(i * i % 11), 2.0 * (i % 7) + i % 3, "train" if i < 40 else "test") for i in range(50)]


@pytest.fixture
def fitted(monkeypatch):
    names, real = [], runs.fit_model

    def noted(train, spec, order=()):
        names.append(spec.name)
        return real(train, spec, order)

    monkeypatch.setattr(runs, "fit_model", noted)
    return names


def test_a_grid_goes_on(spark, data, tmp_path, fitted):
    df, path = make(spark, data), str(tmp_path / "runs")
    first = runs.run_grid_logged(df, ["x", "z"], "y", LINEAR[:1], path, ["id"])
    assert rows(first, "run", "reused") == [("ridge", False)] and fitted == ["ridge"]
    tree = Spec("tree", "random_forest", {"trees": 2, "depth": 3})
    specs = [tree, *LINEAR]
    again = runs.run_grid_logged(df, ["x", "z"], "y", specs, path, ["id"])
    assert rows(again, "run", "reused") == [("naive_mean", False), ("ridge", True), ("tree", False)]
    assert sorted(fitted) == ["naive_mean", "ridge", "tree"]
    want = {r.run: r for r in ex.run_grid(df, ["x", "z"], "y", specs, ["id"]).collect()}
    for r in again.collect():
        assert (r.model, r.params, r.pos, r.n) == (want[r.run].model, want[r.run].params, want[r.run].pos, want[r.run].n)
        assert (r.mae, r.rmse, r.r2) == pytest.approx((want[r.run].mae, want[r.run].rmse, want[r.run].r2)) and r.seconds > 0
    # Rows in another order, and another name for the same parameters, are the same runs.
    renamed = [Spec("other", "ridge", dict(SPECS["ridge"].params)), SPECS["ridge"]]
    same = runs.run_grid_logged(make(spark, data[::-1]), ["x", "z"], "y", renamed, path, ["id"])
    assert rows(same, "run", "reused") == [("other", True), ("ridge", True)] and len(fitted) == 3


def test_what_makes_another_run(spark, data):
    key = lambda d, features=("x", "z"), label="y", spec=LINEAR[0]: runs.run_keys(make(spark, d), features, label, [spec], ["id"])[0]
    moved = [(0, None, 1.0, 0.0, "train"), *data[1:]]
    swapped = [(0, 1.0, None, 0.0, "train"), *data[1:]]
    found = [
        key(data), key(data, ("z", "x")), key(data, ("x",)), key(data, label="z", features=("x",)), key(data + data[:1]),
        key(data + data[:1] * 2), key(moved), key(swapped), key(data[1:]), key([]), key(data, spec=LINEAR[1]),
        key(data, spec=Spec("ridge", "ridge", {"alpha": 2.0})),
    ]
    assert len(set(found)) == len(found) and key(data) == found[0]


def test_a_failed_fit_keeps_the_others(spark, data, tmp_path, fitted):
    df, path = make(spark, data), str(tmp_path / "runs")
    with pytest.raises(ValueError):
        runs.run_grid_logged(df, ["x"], "y", [Spec("bad", "unknown"), *LINEAR], path, ["id"], parallel=1)
    assert runs.read_runs(spark, path).count() == 2
    found = runs.run_grid_logged(df, ["x"], "y", LINEAR, path, ["id"])
    assert [r[1] for r in rows(found, "run", "reused")] == [True, True] and fitted == ["bad", "ridge", "naive_mean"]
