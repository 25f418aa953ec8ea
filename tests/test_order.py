import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tagloom.operators import order, ranks

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """300 rows; one moment holds a third of them."""
    rnd = random.Random(1)
    data = [(i, START + timedelta(minutes=0 if i % 3 == 0 else rnd.randrange(50) - 25)) for i in range(300)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "id long, ts timestamp_ntz")


@pytest.mark.parametrize("finish", [50_000, 7])
def test_split_with_hot_moment(hot, finish):
    data, df = hot
    got = order.time_split(df, "ts", 0.3, "floor", ["id"], finish_rows=finish)
    expected = {i for i, t in sorted(data, key=lambda r: (r[1], r[0]))[: int(300 * 0.7)]}
    assert {r.id for r in got.where("part = 'train'").collect()} == expected
    assert got.count() == 300


@pytest.mark.parametrize("finish", [50_000, 7])
def test_folds(hot, finish):
    data, df = hot
    ranked = [i for i, t in sorted(data, key=lambda r: (r[1], r[0]))]
    folds = order.expanding_folds(df.where("id < 298"), 4, "ts", ["id"], finish_rows=finish)
    kept = [i for i in ranked if i < 298]
    n, m = 298, 298 // 5
    for k in range(1, 5):
        cut = n - (4 - k + 1) * m
        part = {role: set() for role in ("train", "test")}
        for r in folds.where(F.col("fold") == k).collect():
            part[r.role].add(r.id)
        assert part["train"] == set(kept[:cut])
        assert part["test"] == set(kept[cut : cut + m])


def test_published_fold_sizes():
    assert order.fold_bounds(98, 4) == (19, [22, 41, 60, 79])
    with pytest.raises(ValueError):
        order.fold_bounds(4, 4)
    with pytest.raises(ValueError):
        order.fold_bounds(10, 0)


def test_published_split_sizes():
    assert [order._train_rows(n, 0.2, "floor") for n in (98, 34)] == [78, 27]
    assert order._train_rows(34, 0.2, "half_even") == 27
    assert order._train_rows(5, 0.5, "half_even") == 3  # 2.5 rounds to 2 test rows


def test_split_errors(spark):
    df = spark.range(3).withColumn("t", F.lit(date(2024, 1, 1)))
    for size in (0, 1, -0.1):
        with pytest.raises(ValueError):
            order.time_split(df, "t", size, id_cols=["id"])
    with pytest.raises(ValueError):
        order.time_split(df.limit(1), "t", 0.2, id_cols=["id"])
    with pytest.raises(ValueError):
        order.time_split(df, None)
    with pytest.raises(ValueError):
        order.time_split(df, "absent", id_cols=["id"])
    with pytest.raises(TypeError):
        order.time_split(df.withColumn("s", F.array("id")), None, id_cols=["s"])
    with pytest.raises(ValueError, match="tie"):
        order.time_split(df.withColumn("s", F.lit("x")), None, id_cols=["s"])


def test_ties_at_the_boundary_are_an_error(spark):
    df = spark.range(10).withColumn("t", F.lit(date(2024, 1, 1)))
    with pytest.raises(ValueError, match="tie"):
        order.time_split(df, "t", 0.2)
    with pytest.raises(ValueError, match="tie"):
        order.expanding_folds(df, 4, "t")
    assert order.time_split(df, "t", 0.2, id_cols=["id"]).where("part = 'test'").count() == 2


@pytest.mark.parametrize("finish", [50_000, 7])
def test_text_and_decimal_ids(spark, finish):
    rnd = random.Random(3)
    texts = list({"".join(rnd.choices("abé\u4e2d-0", k=rnd.randrange(0, 20))) for _ in range(200)})
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "s string, i long")
    got = {r.s for r in order.time_split(df, None, 0.3, id_cols=["s"], finish_rows=finish).where("part = 'train'").collect()}
    assert got == set(sorted(texts, key=str.encode)[: int(len(texts) * 0.7)])
    big = df.selectExpr("CAST('12000000000000000000' AS DECIMAL(38,0)) + i AS d")
    assert order.time_split(big, None, 0.3, id_cols=["d"], finish_rows=finish).where("part = 'test'").count() == len(texts) - int(len(texts) * 0.7)


def test_rank_search_ends_on_the_widest_doubles(spark):
    values = [-1.7e308, 1.7e308, -1.0, 0.0, 5e-324, 1.0] * 20
    df = spark.createDataFrame([("a", v) for v in values], "series string, v double")
    found = ranks.order_statistics(df, lambda n: [1, n // 2, n], finish_rows=3)
    assert [v for v, _ in found["a"]] == [sorted(values)[k] for k in (0, 59, 119)]


def test_split_drops_missing_times(spark):
    df = spark.createDataFrame([(i, None if i < 5 else date(2024, 1, i)) for i in range(1, 15)], "id long, d date")
    got = order.time_split(df, "d", 0.2, id_cols=["id"])
    assert sorted(r.id for r in got.where("part = 'test'").collect()) == [13, 14]
    assert got.count() == 10


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1.5]), min_size=1, max_size=60),
    finish=st.sampled_from([1, 5, 1000]),
)
def test_order_statistics(spark, values, finish):
    df = spark.createDataFrame([("s", v) for v in values], "series string, v double")
    asked = sorted({1, (len(values) + 1) // 2, len(values)})
    got = ranks.order_statistics(df, lambda n: asked, finish)["s"]
    ordered = sorted(values)
    assert [v for v, _ in got] == [ordered[r - 1] for r in asked]
    assert [b for _, b in got] == [sum(x < ordered[r - 1] for x in values) for r in asked]


def test_order_statistics_of_huge_ids(spark):
    ids = [2**62 + i for i in range(40)] + [-(2**62), 0]
    df = spark.createDataFrame([("s", v) for v in ids], "series string, v long")
    got = ranks.order_statistics(df, lambda n: [1, 2, 10, n], 1)["s"]
    assert [v for v, _ in got] == [sorted(ids)[r] for r in (0, 1, 9, 41)]


def test_row_index(hot):
    data, df = hot
    got = order.with_time_index(df, "ts", "id")
    expected = {i: n for n, (i, t) in enumerate(sorted(data, key=lambda r: (r[1], r[0])), 1)}
    assert {r.id: r.rn for r in got.collect()} == expected


@pytest.mark.parametrize("limit", [10**6, 3])
def test_group_index(hot, limit):
    data, df = hot
    grouped = df.withColumn("g", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b"))
    got = ranks.group_index(grouped, ["g"], ["ts", "id"], max_group_rows=limit)
    by_group = {}
    for i, t in sorted(data, key=lambda r: (r[1], r[0])):
        by_group.setdefault(i % 3, []).append(i)
    expected = {i: n for ids in by_group.values() for n, i in enumerate(ids, 1)}
    assert {r.id: r.rn for r in got.collect()} == expected


def test_group_index_spreads_one_group(spark):
    """A group above the limit is numbered in many partitions, also where its numbers are joined by a shuffle."""
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id"), (F.col("id") * 7919 % 4001).alias("ts")).repartition(4)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = ranks.group_index(df, ["g"], ["ts"], max_group_rows=100)
        placed = [(r.ts, r.rn, r.p) for r in got.withColumn("p", F.spark_partition_id()).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [n for _, n, _ in sorted(placed)] == list(range(1, 4001))
    assert max(Counter(p for _, _, p in placed).values()) < 2000


def test_top_and_best(spark):
    df = spark.createDataFrame(
        [("a", "x", 2.0), ("a", "y", 1.0), ("a", "z", 1.0), ("b", "x", None), ("b", "y", 5.0)], "g string, m string, v double"
    )
    assert rows(order.best_by(df, ["g"], "v", ["m"])) == [("a", "y", 1.0), ("b", "y", 5.0)]
    assert rows(order.best_by(df, ["g"], "v", ["m"], largest=True)) == [("a", "x", 2.0), ("b", "y", 5.0)]
    assert [r.m for r in order.top_n(df, "v", 2, ["m"]).collect()] == ["y", "x"]
    variants = order.top_n_variants(df, "v", [1, 3], ["m"])
    assert rows(variants, "variant", "rank", "v") == [("top_1", 1, 5.0), ("top_3", 1, 5.0), ("top_3", 2, 2.0), ("top_3", 3, 1.0)]


def test_published_ranking(spark):
    best = spark.createDataFrame(
        [("target_nh3", 1.334134, -0.009601), ("target_t", 0.387203, 0.03603), ("target_cl", 0.733118, 0.006915)],
        "target string, mae double, r2 double",
    )
    got = {r.target: (r["rank"], r.status) for r in order.rank_targets(best).collect()}
    assert got == {"target_t": (1, "best_target"), "target_cl": (2, "positive_r2"), "target_nh3": (3, "hardest_target")}
