from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.models.fit import persistence
from tagloom.operators import series

START = datetime(2024, 1, 1)
SMALL = {"max_group_rows": 3, "block_rows": 4}


@pytest.fixture(scope="module")
def readings(spark):
    data = [
        (i, "hot" if i % 3 else ["a", "b", None][i // 3 % 3], START + timedelta(minutes=i // 2), None if i == 7 else float(i * i % 17))
        for i in range(60)
    ]
    return spark.createDataFrame(data, "id long, tag string, ts timestamp_ntz, v double").repartition(5)


def test_blocks_equal_plain_windows(readings):
    order, part = ["ts", "id"], ["tag"]

    def both(fn):
        return rows(fn({})), rows(fn(SMALL))

    for fn in (
        lambda k: series.add_lags(readings, ["v", "absent"], [1, 2], order, part, **k),
        lambda k: series.add_rolling_mean(readings, ["v"], [2, 3], order, part, **k),
        lambda k: series.add_horizon_label(readings, "v", 2, order, part, **k),
        lambda k: series.add_lags(readings, ["v"], [3], order, [], **k),
        lambda k: persistence(readings, "v", order, part, **k),
        lambda k: series.temporal_features(readings, order, part, signals=("v",), **k),
    ):
        plain, blocked = both(fn)
        assert plain == blocked and len(plain) == 60


def test_lag_and_rolling_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])], "i int, v double")
    out = series.add_rolling_mean(series.add_lags(df, ["v"], [1, 2], ["i"]), ["v"], [3], ["i"]).orderBy("i").collect()
    assert [r.v_lag1 for r in out] == [None, 1.0, 2.0, None, 4.0, 5.0]
    assert [r.v_lag2 for r in out] == [None, None, 1.0, 2.0, None, 4.0]
    assert [r.v_roll3_mean for r in out] == [None, None, None, None, None, 5.0]


def test_window_wider_than_a_block(readings):
    with pytest.raises(ValueError):
        series.add_lags(readings, ["v"], [4], ["ts", "id"], ["tag"], **SMALL)


def test_excluding_a_signal(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "i int, temp_offgas_k1 double, fg_header_pressure double")
    dropped = series.temporal_features(df, ["i"], exclude=["temp_offgas_k1"])
    assert "temp_offgas_k1_lag1" not in dropped.columns and "fg_header_pressure_lag1" in dropped.columns
    kept = series.temporal_features(df, ["i"], exclude=["temp_offgas_k1"], exclude_before_lags=False)
    assert "temp_offgas_k1_lag1" in kept.columns and "temp_offgas_k1" not in kept.columns


def test_resample(spark):
    at = [(0, 0), (5, 59), (6, 0), (6, 0)]
    data = [(i, START + timedelta(minutes=m, seconds=s), v) for i, ((m, s), v) in enumerate(zip(at, [1.0, 3.0, 7.0, None]))]
    df = spark.createDataFrame(data, "id long, ts timestamp_ntz, v double")
    got = series.resample(df, "ts", "v", 6, row_id="id").orderBy("step").collect()
    assert [(r.step, r["mean"], r["last"]) for r in got] == [(START, 2.0, 3.0), (START + timedelta(minutes=6), 7.0, 7.0)]
    only = series.resample(df, "ts", "v", 6, stats=("max",))
    assert only.columns == ["step", "max"]


@pytest.mark.parametrize("block,fan", [(1024, 4096), (3, 2)])
def test_resample_filled(spark, monkeypatch, block, fan):
    """Long gaps, a null group, a step whose values are all null, a row without a time, and a single step."""
    monkeypatch.setattr(series, "GRID_BLOCK", block)
    monkeypatch.setattr("tagloom.operators.scans.CARRY_FAN", fan)
    at = [("a", 0, 1.0), ("a", 6, None), ("a", 240, 5.0), ("a", 247, 6.0), (None, 12, 2.0), (None, 90, 3.0), ("b", 3, 9.0), ("c", 0, None), ("c", 18, 4.0)]
    data = [(i, g, START + timedelta(minutes=m), v) for i, (g, m, v) in enumerate(at)] + [(99, "b", None, 7.0)]
    df = spark.createDataFrame(data, "id long, g string, ts timestamp_ntz, v double")
    got = series.resample_filled(df, "ts", "v", 6, ["g"], "id", stats=("mean", "last")).collect()
    by = {(r.g, r.step): r for r in got}
    assert len(by) == len(got) == 42 + 14 + 1 + 4 + 1
    for g, first, last in (("a", 0, 41), (None, 2, 15), ("b", 0, 0), ("c", 0, 3)):
        carried, known = None, {}
        for i, h, t, v in data:
            if h == g and t is not None:
                known.setdefault((t - START) // timedelta(minutes=6), []).append(v)
        for k in range(first, last + 1):
            r, some = by[g, START + timedelta(minutes=6 * k)], [v for v in known.get(k, []) if v is not None]
            carried = some[-1] if some else carried
            assert (r.empty, r["last"]) == (k not in known, carried)
            assert r["mean"] == (sum(some) / len(some) if some else None)
    assert by["b", None]["mean"] == 7.0 and not by["b", None].empty
    assert series.resample_filled(df.limit(0), "ts", "v", 6, ["g"]).collect() == []
    alone = series.resample_filled(df.where("g = 'a'"), "ts", "v", 6, row_id="id")
    assert alone.count() == 42 and alone.where("NOT empty").count() == 4
