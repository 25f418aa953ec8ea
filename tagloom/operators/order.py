"""Chronological splits, folds, rankings and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.operators.columns import require_columns
from tagloom.operators.ranks import (
    FINISH_ROWS,
    at_or_before,
    boundary_keys,
    row_index,
)


def with_time_index(df: DataFrame, time_col: str, id_col: str | list[str], name: str = "rn") -> DataFrame:
    """Rows numbered 1..n by (time, id)."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    return row_index(df, [time_col, *ids], name)


def _train_rows(n: int, test_size: float, rounding: str) -> int:
    if rounding == "floor":
        k = int(n * (1 - test_size))
    elif rounding == "half_even":
        k = n - max(1, int(round(n * test_size)))
    else:
        raise ValueError(f"unknown rounding {rounding!r}")
    if k <= 0 or k >= n:
        raise ValueError(f"cannot split {n} rows with test_size={test_size}")
    return k


def _with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have all order keys, as filters a scan can push down."""
    require_columns(df, keys)
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def _boundaries(rows: DataFrame, keys: list[str], ranks, finish_rows: int) -> list[tuple]:
    """The last key of each of the first parts; an error where ties straddle a boundary."""
    asked: list[int] = []

    def note(n: int) -> list[int]:
        asked[:] = ranks(n)
        return list(asked)

    bounds = boundary_keys(rows, keys, note, finish_rows)
    upto = rows.agg(*[F.count_if(at_or_before(rows, keys, b)).alias(f"n{i}") for i, b in enumerate(bounds)]).first()
    for n, want, bound in zip(upto, asked, bounds):
        if n != want:
            raise ValueError(
                f"{n} rows lie at or before {bound}, {want} were asked for: rows tie in {keys}; add ids that make them unique"
            )
    return bounds


def time_split(
    df: DataFrame,
    time_col: str | None,
    test_size: float = 0.2,
    rounding: str = "floor",
    id_cols: list[str] = (),
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """Add ``part``: the first rows by (time, ids) are 'train', the rest 'test'.

    ``time_col=None`` splits by the declared ids alone; ids may be numbers, times or texts. Rows
    without a time are dropped. Only the key of the last train row is looked up, so the rows
    themselves are never moved. Rows that tie at the boundary are an error, as a table has no
    order of its own to break ties with.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    keys = [*([time_col] if time_col else []), *id_cols]
    if not keys:
        raise ValueError("a split needs a time column or id columns; tables have no row order")
    rows = _with_keys(df, keys)
    [last_train] = _boundaries(rows, keys, lambda n: [_train_rows(n, test_size, rounding)], finish_rows)
    part = F.when(at_or_before(rows, keys, last_train), "train").otherwise("test")
    return rows.withColumn("part", part)


def cutoff_split(df: DataFrame, date_col: str, cutoff: str) -> DataFrame:
    """Add ``part``: 'train' before the cutoff date, 'test' from it on."""
    limit = F.lit(cutoff).cast(df.schema[date_col].dataType)
    rows = df.where(F.col(date_col).isNotNull())
    return rows.withColumn("part", F.when(F.col(date_col) < limit, "train").otherwise("test"))


def fold_bounds(n: int, n_splits: int) -> tuple[int, list[int]]:
    """Test size and the number of train rows of each expanding fold."""
    size = n // (n_splits + 1)
    if n_splits < 1 or n_splits >= n or size == 0:
        raise ValueError(f"cannot cut {n} rows into {n_splits} folds")
    return size, [n - (n_splits - k + 1) * size for k in range(1, n_splits + 1)]


def expanding_folds(
    df: DataFrame,
    n_splits: int,
    time_col: str,
    id_cols: list[str] = (),
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """One copy of a row per fold it takes part in, with ``fold`` and ``role``.

    Fold k tests the k-th of the last ``n_splits`` equal slices and trains on all rows before it.
    """
    keys = [time_col, *id_cols]
    rows = _with_keys(df, keys)
    bounds = _boundaries(rows, keys, lambda n: fold_bounds(n, n_splits)[1], finish_rows)
    # Slice 0 only trains; slice j is the test part of fold j and trains every later fold.
    slice_no = sum(
        (F.when(at_or_before(rows, keys, b), 0).otherwise(1) for b in bounds), F.lit(0)
    )
    folds = F.sequence(F.greatest(F.col("_slice"), F.lit(1)), F.lit(n_splits))
    return (
        rows.withColumn("_slice", slice_no)
        .withColumn("fold", F.explode(folds))
        .withColumn("role", F.when(F.col("fold") == F.col("_slice"), "test").otherwise("train"))
        .drop("_slice")
    )


def top_n(df: DataFrame, score: str, n: int, tiebreak: list[str | Column] = ()) -> DataFrame:
    """The ``n`` rows with the highest score."""
    return df.orderBy(F.col(score).desc_nulls_last(), *tiebreak).limit(n)


def top_n_variants(
    df: DataFrame, score: str, ns: list[int], tiebreak: list[str], prefix: str = "top_"
) -> DataFrame:
    """Several top-N sets at once, with ``variant`` and ``rank``."""
    best = top_n(df, score, max(ns), tiebreak)
    # At most max(ns) rows are left, so one task may number them.
    w = Window.orderBy(F.col(score).desc_nulls_last(), *tiebreak)
    ranked = best.withColumn("rank", F.row_number().over(w).cast("long"))
    sizes = F.filter(F.array(*[F.lit(n) for n in sorted(set(ns))]), lambda n: n >= F.col("rank"))
    return (
        ranked.withColumn("_n", F.explode(sizes))
        .withColumn("variant", F.concat(F.lit(prefix), F.col("_n")))
        .drop("_n")
    )


def best_by(
    df: DataFrame,
    group: list[str],
    metric: str,
    tiebreak: list[str] = (),
    largest: bool = False,
) -> DataFrame:
    """The row with the lowest (or largest) metric of every group; nulls never win."""
    key = -F.col(metric) if largest else F.col(metric)
    row = F.struct(*df.columns)
    rank = F.struct(key.alias("m"), *[F.col(t) for t in tiebreak])
    best = (
        df.where(F.col(metric).isNotNull())
        .groupBy(*group)
        .agg(F.min_by(row, rank).alias("_best"))
    )
    return best.select("_best.*")


def rank_results(
    df: DataFrame, metric: str, tiebreak: list[str] = (), ascending: bool = True, name: str = "rank"
) -> DataFrame:
    """Results numbered by a metric, best first."""
    c = F.col(metric)
    return row_index(df, [c.asc_nulls_last() if ascending else c.desc_nulls_last(), *tiebreak], name)


def first_per_family(df: DataFrame, family: str, position: str) -> DataFrame:
    """The first configuration of every model family, by grid position."""
    return best_by(df, [family], position)


def rank_targets(best: DataFrame, metric: str = "mae", r2: str = "r2", name: str = "target") -> DataFrame:
    """Targets ranked by their best error, with a status.

    The lowest error is ``best_target``; of the others a positive R2 gives ``positive_r2`` and
    the last one without it is ``hardest_target``.
    """
    ranked = rank_results(best, metric, [name])
    last = ranked.agg(F.max("rank")).first()[0]
    status = (
        F.when(F.col("rank") == 1, "best_target")
        .when(F.col(r2) > 0, "positive_r2")
        .when(F.col("rank") == last, "hardest_target")
    )
    return ranked.withColumn("status", status)
