"""Row cleaning and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tagloom.operators.columns import numeric_columns, require_columns


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows once."""
    return df.dropDuplicates()


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without rows in which every column is null (NaN counts as null)."""
    return df.dropna(how="all")


def drop_null_keys(df: DataFrame, names: list[str]) -> DataFrame:
    return require_columns(df, names).dropna(subset=names)


def null_non_finite(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """NaN and infinities become NULL, so that aggregates skip them."""
    wanted = set(names if names is not None else numeric_columns(df))
    floats = [
        f.name
        for f in df.schema.fields
        if f.name in wanted and isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    if not floats:
        return df
    infinite = F.lit(float("inf"))
    return df.withColumns(
        {
            n: F.when(~F.isnan(n) & (F.abs(F.col(n)) != infinite), F.col(n))
            for n in floats
        }
    )


def clean(df: DataFrame) -> DataFrame:
    """Exact duplicates and empty rows removed."""
    return drop_all_null(drop_duplicates(df))


def require_min_rows(df: DataFrame, n: int) -> DataFrame:
    """Error unless the table has at least ``n`` rows; reads no more than ``n``."""
    seen = df.limit(n).count()
    if seen < n:
        raise ValueError(f"too few rows: {seen}, need {n}")
    return df
