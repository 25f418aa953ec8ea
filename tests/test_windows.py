import random
import statistics
from datetime import datetime, timedelta

import pytest
from conftest import rows

from tagloom.operators import scans

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def plant(spark):
    """Readings with ties, a hot moment, nulls and NaN; anchors that share moments."""
    rnd = random.Random(7)
    readings = []
    for i in range(400):
        entity, tag = rnd.choice(["p", "q"]), rnd.choice(["a", "a", "b", "rare" if i % 50 == 0 else "a"])
        minute = 300 if i % 3 == 0 else rnd.randrange(0, 600)
        value = None if i % 41 == 0 else float("nan") if i % 43 == 0 else 1e6 + rnd.random()
        readings.append((i, entity, tag, START + timedelta(minutes=minute), value))
    points = [(i, rnd.choice(["p", "q", "r"]), START + timedelta(minutes=rnd.choice([0, 300, 360, rnd.randrange(700)]))) for i in range(60)]
    sensor = spark.createDataFrame(readings, "row_id long, entity string, tag string, ts timestamp_ntz, value double")
    anchors = spark.createDataFrame(points, "anchor_id long, entity string, ts timestamp_ntz")
    return readings, points, sensor.repartition(4), anchors


def brute(readings, points, lo, hi, entity):
    out = {}
    for a, e, t in points:
        near = {}
        for i, re, tag, ts, v in sorted(readings, key=lambda r: (r[3], r[0])):
            ok = v is not None and v == v and (not entity or re == e)
            if ok and t - timedelta(minutes=lo) < ts <= t - timedelta(minutes=hi):
                near.setdefault(tag, []).append(v)
        for tag, vs in near.items():
            std = statistics.stdev(vs) if len(vs) > 1 else None
            out[a, tag] = (len(vs), statistics.fmean(vs), min(vs), max(vs), std, vs[-1], vs[-1] - vs[0])
    return out


@pytest.mark.parametrize("limit", [10**6, 5])
@pytest.mark.parametrize("window", [("w60", 60, 0), ("w120_30", 120, 30)])
@pytest.mark.parametrize("entity", [[], ["entity"]])
def test_window_features(plant, limit, window, entity):
    readings, points, sensor, anchors = plant
    got = scans.window_features(anchors, sensor, [window], entity=entity, max_group_rows=limit)
    expected = brute(readings, points, window[1], window[2], entity)
    seen = {(r.anchor_id, r.tag): tuple(r)[3:] for r in got.collect()}
    assert seen.keys() == expected.keys()
    for key, want in expected.items():
        have = seen[key]
        assert have[0] == want[0]
        for h, w in zip(have[1:], want[1:]):
            assert h == pytest.approx(w, abs=1e-7) if w is not None else h is None


@pytest.mark.parametrize("limit", [10**6, 5])
def test_window_counts(plant, limit):
    readings, points, sensor, anchors = plant
    window = ("w", 90, 0)
    got = {r.anchor_id: r.rows for r in scans.window_counts(anchors, sensor, window, max_group_rows=limit).collect()}
    times = {r.anchor_id: r.rows for r in scans.window_counts(anchors, sensor, window, distinct_times=True, max_group_rows=limit).collect()}
    for a, _, t in points:
        near = [ts for _, _, _, ts, _ in readings if t - timedelta(minutes=90) < ts <= t]
        assert got[a] == len(near) and times[a] == len(set(near))


@pytest.mark.parametrize("limit", [10**6, 5])
def test_range_join_equals_nested_loop(plant, limit):
    readings, points, sensor, anchors = plant
    got = scans.range_join(anchors, sensor, 45, 5, max_bucket_rows=limit)
    expected = sorted(
        (a, i)
        for a, _, t in points
        for i, _, _, ts, _ in readings
        if t - timedelta(minutes=45) < ts <= t - timedelta(minutes=5)
    )
    assert sorted((r.anchor_anchor_id, r.row_id) for r in got.collect()) == expected


def test_range_join_broadcasts_no_copies(plant, spark, tmp_path, capsys):
    """Small files, whose sizes say nothing about the anchors copied for the salts."""
    readings, points, sensor, anchors = plant
    sensor.write.parquet(f"{tmp_path}/sensor")
    anchors.write.parquet(f"{tmp_path}/anchors")
    got = scans.range_join(spark.read.parquet(f"{tmp_path}/anchors"), spark.read.parquet(f"{tmp_path}/sensor"), 45, max_bucket_rows=1)
    got.explain()
    by_salt = [line for line in capsys.readouterr().out.splitlines() if "Join" in line and "_salt" in line]
    assert by_salt and all("SortMergeJoin" in line for line in by_salt)
    times = [(t, ts) for _, _, t in points for _, _, _, ts, _ in readings]
    assert got.count() == sum(t - timedelta(minutes=45) < ts <= t for t, ts in times)


def exploded(plan):
    """Rows out of every explode of a plan that has run."""
    name, below = plan.nodeName(), plan.children()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
    rows_out = [plan.metrics().apply("numOutputRows").value()] if name == "Generate" else []
    return rows_out + [n for p in inner + [below.apply(i) for i in range(below.size())] for n in exploded(p)]


@pytest.mark.parametrize("readings, salts", [(600, 2), (7000, 3)])
def test_range_join_copies_few_anchors(spark, readings, salts):
    """A limit of three readings a salt does not copy an anchor for every three readings."""
    sensor = spark.range(readings).selectExpr("id AS row_id", "timestamp_ntz'2024-01-01 05:00:01' + make_interval(0, 0, 0, 0, 0, 0, id % 3000) AS ts")
    anchors = spark.range(40).selectExpr("id AS anchor_id", "timestamp_ntz'2024-01-01 05:50:30' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts")
    got = scans.range_join(anchors, sensor, 60, max_bucket_rows=3)
    pairs = {(r.anchor_anchor_id, r.row_id) for r in got.collect()}
    assert pairs == {(a, i) for a in range(40) for i in range(readings)}
    # The bucket before has no readings, so its anchors are not copied.
    assert sorted(exploded(got._jdf.queryExecution().executedPlan())) == [2 * 40, (salts + 1) * 40]
    assert got.count() == len(pairs)


@pytest.mark.parametrize("limit", [10**6, 5])
@pytest.mark.parametrize("tolerance", [None, 30])
def test_asof(plant, tolerance, limit):
    readings, points, sensor, anchors = plant
    hits = scans.asof_join(anchors, sensor, ["a", "b", "rare"], tolerance, max_group_rows=limit)
    got = {(r.anchor_id, r.tag): r.value for r in hits.collect()}
    assert len(got) == 3 * len(points)
    for a, _, t in points:
        for tag in ("a", "b", "rare"):
            past = [
                (ts, i, v)
                for i, _, g, ts, v in readings
                if g == tag and v is not None and v == v and ts <= t
                and (tolerance is None or ts >= t - timedelta(minutes=tolerance))
            ]
            assert got[a, tag] == (max(past)[2] if past else None)


def test_pivot_and_back(plant):
    _, _, sensor, anchors = plant
    long = scans.window_features(anchors, sensor, [("w60", 60, 0), ("w120_30", 120, 30)])
    wide = scans.pivot_window_features(long, ["a", "b", "rare"], ["w60", "w120_30"])
    assert len(wide.columns) == 1 + 2 * 6 * 3 and "w120_30__last__rare" in wide.columns
    back = scans.unpivot_window_features(wide)
    stacked = long.unpivot(["anchor_id", "window", "tag"], list(scans.STATS), "stat", "value").where("value IS NOT NULL")
    assert rows(back, "anchor_id", "window", "tag", "stat", "value") == rows(stacked, "anchor_id", "window", "tag", "stat", "value")


def test_no_readings(spark, plant):
    _, points, sensor, anchors = plant
    empty = sensor.where("false")
    assert scans.window_features(anchors, empty).count() == 0
    counts = scans.window_counts(anchors, empty)
    assert rows(counts) == sorted(((a, 0) for a, _, _ in points), key=str)


def test_null_time_anchors_keep_their_rows(spark):
    anchors = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 1, 1))], "anchor_id long, ts timestamp_ntz")
    sensor = spark.createDataFrame([("a", datetime(2024, 1, 1), 1, 5.0)], "tag string, ts timestamp_ntz, row_id long, value double")
    got = sorted((r.anchor_id, r.tag, r.value) for r in scans.asof_join(anchors, sensor, ["a", "b"]).collect() if r.value)
    assert got == [(2, "a", 5.0)] and scans.asof_join(anchors, sensor, ["a", "b"]).count() == 4


@pytest.mark.parametrize("limit", [0, 1_000_000])
@pytest.mark.parametrize("odd", [-1e9, float("-inf")])
def test_readings_outside_the_window_do_not_spoil_it(spark, odd, limit):
    start = datetime(2024, 1, 1)
    rows = [("a", start, 0, odd)] + [("a", start + timedelta(minutes=31 + i), i + 1, i % 3 + 0.5) for i in range(25)]
    sensor = spark.createDataFrame(rows, "tag string, ts timestamp_ntz, row_id long, value double")
    anchors = spark.createDataFrame([(1, start + timedelta(minutes=90))], "anchor_id long, ts timestamp_ntz")
    r = scans.window_features(anchors, sensor, [("w60", 60, 0)], max_group_rows=limit).first()
    inside = [i % 3 + 0.5 for i in range(25)]
    assert r.n == 25 and r["mean"] == pytest.approx(sum(inside) / 25) and r["std"] == pytest.approx(statistics.stdev(inside))


def test_names_of_tags_with_underscores(spark):
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "anchor_id long, w60__mean__a__b double, other__x double")
    assert [(r.tag, r.stat, r.value) for r in scans.unpivot_window_features(wide).collect()] == [("a__b", "mean", 2.0)]


@pytest.mark.parametrize("fan,levels", [(2, 3), (3, 1), (4096, 2)])
@pytest.mark.parametrize("tolerance,limit", [(None, 10**6), (None, 3), (60 * 24 * 400, 10**6)])
def test_asof_over_years(spark, monkeypatch, fan, levels, tolerance, limit):
    """Readings and anchors from year 1 to 9999, mostly far apart, some close: blocks of all levels are crossed."""
    monkeypatch.setattr(scans, "CARRY_FAN", fan)
    monkeypatch.setattr(scans.carried_hits, "__defaults__", (levels,))
    rnd = random.Random(6)
    begin, near = datetime(1, 1, 2), datetime(2024, 1, 1)
    moment = lambda: rnd.choice([begin + timedelta(days=rnd.randrange(3_650_000)), near + timedelta(minutes=rnd.randrange(4000))])
    readings = [(rnd.choice("ab"), moment(), i, float(i)) for i in range(60)]
    points = [(i, moment()) for i in range(60)] + [(60, datetime(9999, 12, 30))]
    sensor = spark.createDataFrame(readings, "tag string, ts timestamp_ntz, row_id long, value double")
    anchors = spark.createDataFrame(points, "anchor_id long, ts timestamp_ntz")
    got = {(r.anchor_id, r.tag): r.value for r in scans.asof_join(anchors, sensor, ["a", "b"], tolerance, max_group_rows=limit).collect()}
    for i, t in points:
        for tag in "ab":
            past = [(ts, k, v) for g, ts, k, v in readings if g == tag and ts <= t and (tolerance is None or t - ts <= timedelta(minutes=tolerance))]
            assert got[i, tag] == (max(past)[2] if past else None)
