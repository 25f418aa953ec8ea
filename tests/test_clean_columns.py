import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.functions.timecols import coerce_timestamp, floor_div, key_literal, ntz_from_micros, order_key
from tagloom.operators import clean, columns


def test_duplicates_and_empty_rows(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (None, None), (None, None), (2, None)], "x int, y string"
    )
    assert rows(clean.clean(df)) == [(1, "a"), (2, None)]


def test_non_finite_becomes_null(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (2, math.nan), (3, math.inf), (4, -math.inf), (5, None)], "id int, v double"
    )
    assert rows(clean.null_non_finite(df)) == [(1, 1.0), (2, None), (3, None), (4, None), (5, None)]


def test_guards(spark):
    df = spark.range(9)
    with pytest.raises(ValueError, match="too few rows: 9"):
        clean.require_min_rows(df, 10)
    assert clean.require_min_rows(df, 9) is df
    with pytest.raises(ValueError, match="absent"):
        columns.require_columns(df, ["id", "absent"])
    with pytest.raises(ValueError):
        clean.drop_null_keys(df, ["absent"])


def test_column_rules(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2.0, 3.0, "t", True)],
        "id int, w60__mean__a double, w60__last__Target double, w60__min__a double, k1_note string, flag boolean",
    )
    assert columns.numeric_columns(df) == ["id", "w60__mean__a", "w60__last__Target", "w60__min__a"]
    assert columns.feature_columns(df, ["w60__mean__", "w60__last__"]) == ["w60__mean__a"]
    assert columns.feature_columns(df, ["w60__"], ["w60__min__a"], []) == ["w60__mean__a", "w60__last__Target"]
    assert columns.prefix_plus_columns(df, "k1_", ["id", "id", "zz", "k1_note"]) == (["k1_note"], ["id"])
    assert columns.exclude_columns(df, ["flag", "nothing"]).columns == df.columns[:-1]
    with pytest.raises(ValueError):
        columns.select_prefix(df, "zz_")
    with pytest.raises(ValueError):
        columns.feature_columns(df, ["zz"])
    with pytest.raises(ValueError, match="k1_note"):
        columns.validate_numeric(df, ["id", "k1_note"], "strict")
    assert columns.validate_numeric(df, ["id", "k1_note", "flag"], "report") == (["id"], ["k1_note", "flag"])
    with pytest.raises(ValueError):
        columns.select_numeric(df.select("k1_note"))


def test_common_columns(spark):
    a, b = spark.range(1).selectExpr("id AS x", "id AS y"), spark.range(1).selectExpr("id AS y", "id AS x")
    assert [t.columns for t in columns.common_columns(a, b)] == [["x", "y"], ["x", "y"]]
    with pytest.raises(ValueError):
        columns.common_columns(a, spark.range(1))


def test_reconcile(spark):
    wanted = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "a")], "pos int, feature string")
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    found, missing = columns.reconcile_features(wanted, df)
    assert columns.feature_names(found) == ["b", "a"]
    assert columns.feature_names(missing) == ["zz"]
    with pytest.raises(ValueError, match="zz"):
        columns.require_features(wanted, df)
    assert columns.require_features(wanted.where("feature <> 'zz'"), df) == ["b", "a"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        moments = ["2024-03-10 02:30:00.000001", "1969-12-31 23:59:59.5", "2024-11-03 01:30:00"]
        df = spark.createDataFrame([(m,) for m in moments], "s string").selectExpr("s", "cast(s as timestamp_ntz) t")
        micros = [r[0] for r in df.select(order_key(df, "t")).collect()]
        assert micros == [1710037800000001, -500000, 1730597400000000]
        back = df.select((ntz_from_micros(order_key(df, "t")) == F.col("t")).alias("ok"))
        assert rows(back) == [(True,)] * 3
        same = [key_literal(df.schema["t"].dataType, m) for m in micros]
        assert df.where((F.col("t") == same[0]) | (F.col("t") == same[1]) | (F.col("t") == same[2])).count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_floor_div_below_zero(spark):
    got = spark.createDataFrame([(-7,), (-6,), (0,), (5,), (6,)], "x long").select(floor_div(F.col("x"), 6))
    assert [r[0] for r in got.collect()] == [-2, -1, 0, 0, 1]


def test_bad_time_text(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("n/a",), (None,)], "t string")
    out = coerce_timestamp(df, "t")
    assert out.dtypes == [("t", "timestamp_ntz")]
    assert out.where("t IS NULL").count() == 2
