import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings, strategies as st

from tagloom.operators import impute

SCHEMA = "id int, a double, b double, c double, part string"


@pytest.fixture(scope="module")
def table(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, 1.0, None, None, "train"), (2, 3.0, 4.0, None, "train"), (3, None, nan, None, "train"),
        (4, 2.0, inf, None, "train"), (5, None, None, 9.0, "test"), (6, 100.0, 100.0, None, "test"),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("cells", [10**6, 0])
def test_medians(table, cells):
    train = impute.fit_medians(table, ["a", "b", "c"], max_cells=cells, finish_rows=1)
    assert tuple(train.first()) == (2.0, 4.0, None)
    everything = impute.fit_medians(table, ["a", "b", "c"], where=None, max_cells=cells, finish_rows=1)
    assert tuple(everything.first()) == (2.5, 52.0, 9.0)


def test_fill(table):
    medians = impute.fit_medians(table, ["a", "b", "c"])
    assert rows(impute.impute_median(table, medians), "id", "a", "b", "c") == [
        (1, 1.0, 4.0, None), (2, 3.0, 4.0, None), (3, 2.0, 4.0, None),
        (4, 2.0, 4.0, None), (5, 2.0, 4.0, 9.0), (6, 100.0, 100.0, None),
    ]
    zero = impute.impute_median(table, medians, fallback=0.0)
    assert rows(zero, "id", "c")[0] == (1, 0.0)
    assert impute.impute_median(table, medians, drop_empty=True).columns == ["id", "a", "b", "part"]
    rates = dict(rows(impute.null_rates(table, ["a", "c"])))
    assert rates == {"a": pytest.approx(1 / 3), "c": pytest.approx(5 / 6)}


def test_test_rows_do_not_matter(spark, table):
    changed = table.selectExpr("id", "if(part = 'test', -999.0, a) a", "if(part = 'test', 1e9, b) b", "c", "part")
    for cells in (10**6, 0):
        before, after = (impute.fit_medians(t, ["a", "b"], max_cells=cells).first() for t in (table, changed))
        assert before == after


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 200), st.integers(0, 10**6))
def test_counted_median_is_exact(spark, n, seed):
    rnd = random.Random(seed)
    values = [rnd.choice([rnd.gauss(0, 1), rnd.choice([1.0, 2.0]), rnd.gauss(1e8, 1e7)]) for _ in range(n)]
    df = spark.createDataFrame([(i, v, "train") for i, v in enumerate(values)], "id int, a double, part string")
    got = impute.fit_medians(df, ["a"], max_cells=0, finish_rows=3).first()[0]
    assert got == pytest.approx(statistics.median(values), rel=1e-15)


def test_bracketed_medians_of_many_columns(spark):
    """Ties, gaps, signs, a heavy value at the middle, one and two values, and none; in two passes and in many."""
    rnd, n = random.Random(4), 3000
    make = [
        lambda i: rnd.gauss(0, 1), lambda i: float(rnd.randrange(5)), lambda i: 7.0, lambda i: float(i % 2), lambda i: -1e300 * rnd.random(),
        lambda i: None if i % 3 else rnd.random(), lambda i: 5.0 if rnd.random() < 0.4 else rnd.gauss(5, 1), lambda i: 1.5 if i == 9 else None,
        lambda i: float(i) if i < 2 else None, lambda i: None, lambda i: 0.0 if i < n / 2 else 1.0, lambda i: float("inf") if i % 5 else -3.0 + i,
    ]
    cols = [f"c{k}" for k in range(len(make))]
    data = [tuple(f(i) for f in make) for i in range(n)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in cols)).repartition(6).cache()
    known = [[v for v in column if v is not None and abs(v) != float("inf")] for column in zip(*data)]
    want = [statistics.median(v) if v else None for v in known]
    for held in (10**6, 12 * 40, 1):
        assert list(impute.fit_medians(df, cols, where=None, max_cells=0, finish_rows=held).first()) == want


def test_bad_sketches_only_cost_passes(spark, monkeypatch):
    """Brackets that miss the middle altogether: counts still find it."""
    from tagloom.operators import medians

    df = spark.range(501).selectExpr("cast((id * 7919) % 501 AS double) AS a", "cast(id % 3 AS double) AS b").cache()
    narrow = medians._narrow

    def misled(rows, searches, *rest):
        for s in searches:
            if s.low is None and s.high is None:
                s.bracket = wrong
        return narrow(rows, searches, *rest)

    monkeypatch.setattr(medians, "_narrow", misled)
    for wrong in ((-1.0, 0.5), (300.0, 400.0)):
        for held in (1, 200):
            assert list(impute.fit_medians(df, ["a", "b"], where=None, max_cells=0, finish_rows=held).first()) == [250.0, 1.0]


def test_two_passes_over_a_wide_table(spark, monkeypatch):
    from tagloom.operators import medians

    passes, narrow = [], medians._narrow
    monkeypatch.setattr(medians, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    cols = [f"v{k}" for k in range(80)]
    df = spark.range(2000).select(*[((F.col("id") * (2 * k + 1)) % 1999 + k).cast("double").alias(c) for k, c in enumerate(cols)])
    got = impute.fit_medians(df, cols, where=None, max_cells=0).first()
    want = df.agg(*[F.median(c).alias(c) for c in cols]).first()
    assert tuple(got) == tuple(want) and len(passes) == 1
