import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.models.fit import NaiveMean, assemble, fit_model, predict
from tagloom.models.specs import SPECS
from tagloom.operators.metrics import fold_summary, union_all
from tagloom.sources import sinks, staging, tables


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿time,v,s\n2024-01-02 03:04:05,1.5,x\n,2,\n", encoding="utf-8")
    df = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["time", "v", "s"] and dict(df.dtypes)["v"] == "double"
    typed = tables.read_table(spark, str(tmp_path), "csv", "time timestamp_ntz, v double, s string", "a")
    assert rows(typed)[-1] == (datetime(2024, 1, 2, 3, 4, 5), 1.5, "x")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "absent.csv"))


def test_feature_list(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("feature\nb\na\n\nb\nc\na\n", encoding="utf-8-sig")
    got = [r.feature for r in tables.load_feature_list(spark, str(path)).orderBy("pos").collect()]
    assert got == ["b", "a", "c"]
    path.write_text("name\nb\n")
    with pytest.raises(ValueError, match="no column"):
        tables.load_feature_list(spark, str(path))
    path.write_text("feature,x\n,1\n")
    with pytest.raises(ValueError, match="empty"):
        tables.load_feature_list(spark, str(path))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", 1.0, 2.0, 0.5)], "run string, mae double, rmse double, r2 double")
    sinks.write_metrics(df, f"{tmp_path}/m", "csv")
    assert rows(tables.read_table(spark, f"{tmp_path}/m")) == [("r", 1.0, 2.0, 0.5)]
    for _ in range(2):
        sinks.write_run_log(df, f"{tmp_path}/log")
    log = tables.read_table(spark, f"{tmp_path}/log", "parquet")
    assert log.count() == 2
    assert log.where(F.col("run_date").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$")).count() == 2
    sinks.write_predictions(df, f"{tmp_path}/p")
    sinks.write_predictions(df, f"{tmp_path}/p")
    assert tables.read_table(spark, f"{tmp_path}/p", "parquet").count() == 1


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    train = assemble(df, ["x"], "y")
    model = fit_model(train, SPECS["ridge"])
    path = sinks.save_model(model, str(tmp_path), "tag", "ridge")
    assert path.endswith("/tag_ridge")
    again = sinks.load_model(path)
    assert rows(predict(again, train)) == rows(predict(model, train))


def test_mean_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    train = assemble(df, ["x"], "y")
    for rows_, mean in ((train, 3.0), (train.limit(0), None)):
        path = sinks.save_model(fit_model(rows_, SPECS["naive_mean"]), str(tmp_path), "tag", "mean")
        assert NaiveMean.load(path).mean == mean


def test_run_info(spark, tmp_path):
    folds = spark.createDataFrame(
        [("fold_2", 1.0, 2.0, 0.5), ("fold_1", 2.0, 3.0, 0.25)], "fold string, mae double, rmse double, r2 double"
    )
    info = sinks.run_info(folds, {"experiment_name": "опыт", "n_splits": 2}, fold_summary(folds))
    sinks.write_run_info(info, f"{tmp_path}/i")
    [line] = [x for f in (tmp_path / "i").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    doc = json.loads(line)
    assert doc["experiment_name"] == "опыт" and [f["fold"] for f in doc["folds"]] == ["fold_1", "fold_2"]
    assert doc["summary"]["mae_mean"] == 1.5


def test_union_all(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2)], "s string, i int")
    assert rows(union_all([a, b])) == [(1, "x"), (2, "y")]


def test_staging(spark):
    df = spark.range(10).withColumn("r", F.rand())
    fixed = staging.stage(df)
    assert rows(fixed) == rows(fixed) and fixed.schema.names == df.schema.names
    assert staging.shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
