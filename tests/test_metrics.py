import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.operators import metrics as m

# Published predictions of two model runs and the metrics printed for them.
T_TRUE = [31.0, 31.0, 31.0, 30.0, 30.0, 30.0, 30.0, 30.0, 31.0, 30.0, 31.0, 31.0, 31.0, 31.0, 31.0, 31.0]
T_PRED = [
    30.69222222222222, 30.39527777777778, 31.003174603174607, 30.333611111111114, 30.89318253968254,
    30.543055555555554, 30.383571428571425, 30.185, 30.955380952380953, 30.534055555555558, 30.971484126984116,
    30.482388888888885, 31.024960317460305, 30.255555555555553, 30.711388888888887, 30.24166666666666,
]
CL_TRUE = [97.7, 97.5, 98.6, 98.6, 98.3, 96.2, 96.1, 98.3, 98.3, 98.6, 98.6, 97.3, 98.1, 98.6, 98.6, 98.6]
CL_PRED = [
    97.22953401988028, 97.34455769888908, 97.86175392412522, 98.31898558396293, 97.94878975378066,
    97.23100673443803, 96.58204404421991, 97.13009396358026, 97.11364707761771, 98.6972834857588,
    98.37555987434537, 97.7921985063721, 97.59844760231246, 96.93875057041303, 97.64556376913758, 98.07328718076317,
]
PUBLISHED = {
    "t": (16, 0.38720287698412825, 0.47532133761922335, 0.03603040428318849),
    "cl": (16, 0.6452226094988154, 0.773226054288968, 0.08720834957055223),
}
FOLDS = [
    ("fold_1", 2.1229035087719246, 2.7812289922694142, 0.019811528335607842),
    ("fold_2", 4.032999999999996, 5.1724659839481495, 0.21686048662078194),
    ("fold_3", 4.291105263157874, 4.755381059609426, 0.16653890705436947),
    ("fold_4", 3.160833333333323, 3.9201551698935075, 0.18150432452198428),
]


@pytest.fixture(scope="module")
def published(spark):
    pairs = [("t", a, b) for a, b in zip(T_TRUE, T_PRED)] + [("cl", a, b) for a, b in zip(CL_TRUE, CL_PRED)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, target string, y_true double, y_pred double")


@pytest.fixture(scope="module")
def folds(spark):
    return spark.createDataFrame(FOLDS, "fold string, mae double, rmse double, r2 double")


def test_published_metrics(published):
    for r in m.regression_metrics(published, ["target"]).collect():
        assert tuple(r)[1:] == pytest.approx(PUBLISHED[r.target], rel=1e-9)


def test_published_fold_summary(folds):
    s = m.fold_summary(folds).first()
    assert s.rmse_mean == pytest.approx(4.157307801, abs=1e-9)
    assert s.rmse_std == pytest.approx(0.913519570, abs=1e-9)
    assert (round(s.r2_mean, 4), round(s.r2_std, 4)) == (0.1462, 0.0752)


def test_verdicts(folds):
    assert m.stability_verdict(folds).first().verdict == "stable"
    one = folds.withColumn("r2", F.when(F.col("fold") == "fold_1", -0.1).otherwise(F.col("r2")))
    assert m.stability_verdict(one).first().verdict == "conditional"
    assert m.stability_verdict(folds.withColumn("r2", -F.col("r2"))).first().verdict == "weak"


def test_constant_truth(spark):
    df = spark.createDataFrame(
        [("perfect", 2.0, 2.0)] * 2 + [("off", 2.0, 3.0)] * 2 + [("gone", None, 1.0)], "g string, y_true double, y_pred double"
    )
    got = {r.g: (r.n, r.r2) for r in m.regression_metrics(df, ["g"]).collect()}
    assert got == {"perfect": (2, 1.0), "off": (2, 0.0)}


def test_delta_and_comparison(spark):
    schema = "variant string, rmse double, r2 double, params string"
    base = spark.createDataFrame([("base", 4.0, 0.1, "{}")], schema)
    more = spark.createDataFrame([("top_3", 3.5, 0.2, "{}"), ("top_5", 3.5, 0.05, "x")], schema)
    got = rows(m.comparison_table(base, more, base), "variant", "delta_rmse", "not_worse", "same_params")
    assert got == [("base", 0.0, True, True), ("top_3", -0.5, True, True), ("top_5", -0.5, False, False)]
    with pytest.raises(ValueError):
        m.delta_vs_baseline(more, more)


def test_wide_long_names_gate(spark):
    df = spark.createDataFrame(
        [("e", "ridge", 1.0, 2.0, -0.5), ("e", "other", 3.0, 4.0, 0.5)], "exp string, model string, mae double, rmse double, r2 double"
    )
    wide = m.wide_summary(df, ["exp"], {"ridge": "ridge", "random_forest": "rf"})
    assert wide.columns == ["exp", "ridge_mae", "ridge_rmse", "ridge_r2", "rf_mae", "rf_rmse", "rf_r2"]
    assert tuple(wide.first()) == ("e", 1.0, 2.0, -0.5, None, None, None)
    assert m.metric_long(df, ["exp", "model"]).count() == 6
    assert rows(m.display_name(df), "model_display_name") == [("Ridge",), ("other",)]
    assert rows(m.accept_gate(df, 0.15), "model", "accepted") == [("other", True), ("ridge", False)]


def test_histogram(spark, published):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 4, 10]], "residual double")
    got = m.residual_histogram(df, 5).orderBy("bin").collect()
    assert [r.n for r in got] == [3, 0, 1, 0, 1]
    assert (got[0].bin_from, got[4].bin_to) == (0.0, 10.0)
    same = m.residual_histogram(df.limit(1), 3).orderBy("bin").collect()
    assert [r.n for r in same] == [1, 0, 0]
    assert m.residual_histogram(df.where("false"), 3).count() == 0
    r = m.residuals(published).where("id = 0").first()
    assert r.abs_err == pytest.approx(0.3077777777777797) and r.residual == r.abs_err


def test_series_index(published):
    got = m.test_series(published.withColumn("model", F.lit("m")), ["id"])
    assert rows(got.where("target = 'cl'"), "test_index") == sorted([(i,) for i in range(16)], key=str)


def test_profile_and_sizes(spark):
    df = spark.createDataFrame([(1, "a", "train"), (None, "b", "test"), (3, "c", "train")], "x int, s string, part string")
    got = {r.column_name: tuple(r)[1:] for r in m.column_profile(df).collect()}
    assert got["x"] == ("int", 1, pytest.approx(1 / 3), "1", "3")
    assert got["s"] == ("string", 0, 0.0, "a", "c")
    assert tuple(m.run_sizes(df, 7).first()) == (3, 7, 2, 1)
    assert math.isclose(sum(r.n for r in m.residual_histogram(df.selectExpr("double(x) residual"), 2).collect()), 2)
