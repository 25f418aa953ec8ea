"""Median imputation from training rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagloom.operators.medians import HELD_VALUES, medians as bracketed_medians

MAX_MEDIAN_CELLS = 4_000_000  # rows times columns up to which one aggregate may hold all values
TRAIN = "part = 'train'"


def fit_medians(
    df: DataFrame,
    cols: list[str],
    where: str | None = TRAIN,
    max_cells: int = MAX_MEDIAN_CELLS,
    finish_rows: int = HELD_VALUES,
) -> DataFrame:
    """One row with the exact median of every column over the rows ``where`` selects.

    ``where=None`` uses all rows, which leaks test data into training. Null, NaN and infinite
    values are left out; a column without values gets NULL. The built-in median keeps the
    distinct values of a column in one buffer, so it is only used below ``max_cells``; above, sketches
    give brackets of the middle ranks, and passes that hold about ``finish_rows`` values in all narrow them.
    """
    rows = df if where is None else df.where(where)
    infinite = F.lit(float("inf"))

    def finite(c: str):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != infinite), v)

    if rows.count() * len(cols) <= max_cells:
        return rows.agg(*[F.median(finite(c)).alias(c) for c in cols])
    values = bracketed_medians(rows, cols, finite, finish_rows)
    schema = ", ".join(f"`{c}` double" for c in cols)
    return df.sparkSession.createDataFrame([tuple(values)], schema)


def impute_median(
    df: DataFrame,
    medians: DataFrame,
    fallback: float | None = None,
    drop_empty: bool = False,
) -> DataFrame:
    """Fill null (and non-finite) values with the given one-row medians.

    Columns without a median keep their nulls, take ``fallback``, or are dropped. The medians are
    one row, so they become constants of the plan and no join is needed.
    """
    fitted = medians.first().asDict()
    empty = [c for c, m in fitted.items() if m is None]
    out = df.drop(*empty) if drop_empty else df
    infinite = F.lit(float("inf"))
    filled = {}
    for c, m in fitted.items():
        if c not in out.columns:
            continue
        v = F.col(c).cast("double")
        finite = F.when(~F.isnan(v) & (F.abs(v) != infinite), v)
        value = m if m is not None else fallback
        filled[c] = finite if value is None else F.coalesce(finite, F.lit(float(value)))
    return out.withColumns(filled) if filled else out


def null_rates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of missing values per column, to look at before imputing."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "null_rate")
