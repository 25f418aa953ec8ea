from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.functions import labels
from tagloom.operators import lab

RAW = ["g1", "g2", "g3"]
CASES = [
    # book date, range, readings -> mid time, block, valid, mean, flag, text
    (date(2026, 2, 20), "20:00-21:00", "54.2", "52", "55.3", datetime(2026, 2, 19, 20, 30), "night_20_08", 3, 53.833333, "OK_3GROUPS", None),
    (date(2026, 2, 20), "02:00-03:00", "70.9", "64.5", "71.6", datetime(2026, 2, 20, 2, 30), "night_20_08", 3, 69.0, "OK_3GROUPS", None),
    (date(2026, 2, 20), "06:00-07:00", None, "61.4", None, datetime(2026, 2, 20, 6, 30), "night_20_08", 1, 61.4, "PARTIAL_1GROUP", None),
    (date(2026, 2, 20), "08:00-09:00", "67.8", "66.1", "66.3", datetime(2026, 2, 20, 8, 30), "day_08_20", 3, 66.733333, "OK_3GROUPS", None),
    (date(2026, 2, 23), "02:00-03:00", "пер", "61.7", "77", datetime(2026, 2, 23, 2, 30), "night_20_08", 2, 69.35, "PARTIAL_WITH_TEXT_FLAGS", "пер"),
    (date(2026, 2, 23), "23:00-24:00", " 1e1 ", "", "2d", datetime(2026, 2, 22, 23, 30), "night_20_08", 1, 10.0, "PARTIAL_WITH_TEXT_FLAGS", "2d"),
    (date(2026, 2, 23), "12:00-13:00", None, None, None, datetime(2026, 2, 23, 12, 30), "day_08_20", 0, None, None, None),
    (date(2026, 2, 23), "12:00-13:00", "5", "6", None, datetime(2026, 2, 23, 12, 30), "day_08_20", 2, 5.5, None, None),
]


@pytest.fixture(scope="module")
def samples(spark):
    raw = [(i, *c[:5]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(raw, "i int, book_date date, time_range string, g1 string, g2 string, g3 string")
    return lab.lab_samples(df, "co2_after_klpk", RAW)


def test_samples(samples):
    got = samples.select(
        "i", "timestamp_mid", "block", "valid_groups_count", F.round("value_mean", 6), "quality_flag", "manual_text_flags"
    )
    assert [tuple(r)[1:] for r in got.orderBy("i").collect()] == [c[5:] for c in CASES]


def test_event_id_and_ends(samples):
    first = samples.where("i = 0").first()
    assert first.event_id == "co2_after_klpk__20260219T2030"
    assert first.timestamp_start == datetime(2026, 2, 19, 20)
    assert first.timestamp_end == datetime(2026, 2, 19, 21)
    last = samples.where("i = 5").first()
    assert last.timestamp_end == datetime(2026, 2, 23)


def test_shift_labels(spark):
    cases = [
        (None, 12), ("1", 8), (" 1.0 ", 8), ("I", 8), ("1 смена", 8), ("Смена 1", 8), ("2", 20), ("2.0", 20),
        ("2 смена", 20), ("II", 20), ("x2", 20), ("12", 8), ("ночь", 12), ("", 12),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    got = df.select("i", labels.shift_hour(F.col("s"))).orderBy("i").collect()
    assert [r[1] for r in got] == [h for _, h in cases]
    at = df.select(labels.proxy_time(F.lit(date(2026, 3, 1)), F.col("s")).alias("t"), "i").orderBy("i").collect()
    assert at[1].t == datetime(2026, 3, 1, 8) and at[6].t == datetime(2026, 3, 1, 20)


def test_counts(samples):
    by_day = {r.date: tuple(r)[1:] for r in lab.quality_by_day(samples).collect()}
    assert by_day[date(2026, 2, 19)] == (1, 1, 0, 0)
    assert by_day[date(2026, 2, 23)] == (3, 0, 0, 1)
    parts = lab.quality_by_part(samples, [("a", "2026-02-19", "2026-02-20"), ("b", "2026-02-20", "2026-02-28")])
    got = {r.part: (r.rows, r.ok_3groups) for r in parts.collect()}
    assert got == {"a": (4, 3), "b": (7, 2)}
    lists = lab.list_per_day(samples, "book_date", "time_range", "x")
    assert rows(lists)[1] == (date(2026, 2, 23), "02:00-03:00; 12:00-13:00; 23:00-24:00")


def test_shift_merge(spark):
    readings = [
        (datetime(2026, 1, 1, 20, 5), 1.0), (datetime(2026, 1, 1, 20, 50), 3.0), (datetime(2026, 1, 2, 7, 59), 6.0),
        (datetime(2026, 1, 2, 8, 0), 9.0),
    ]
    sensor = spark.createDataFrame([("a", t, v) for t, v in readings], "tag string, ts timestamp_ntz, value double")
    shifts = lab.shift_features(sensor)
    got = {(r.book_date, r.block): (r["mean"], r["min"], r["max"]) for r in shifts.collect()}
    assert got == {
        (date(2026, 1, 2), "night_20_08"): (4.0, 2.0, 6.0),
        (date(2026, 1, 2), "day_08_20"): (9.0, 9.0, 9.0),
    }
    wide = lab.pivot_shift_features(shifts, ["a", "b"], ["mean"], prefix="k1")
    books = spark.createDataFrame(
        [(1, date(2026, 1, 2), "night_20_08"), (2, date(2026, 1, 5), "night_20_08")], "id int, book_date date, block string"
    )
    merged = lab.merge_shift(books, wide)
    assert rows(merged, "id", "k1_a_mean", "k1_b_mean") == [(1, 4.0, None), (2, None, None)]
