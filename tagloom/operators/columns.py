"""Choosing columns by type and by name. Everything here is resolved from the schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

PREVIEW = 20


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_numeric(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Numeric columns (plus ``keep``); error if there is none."""
    names = numeric_columns(df)
    if not names:
        raise ValueError("no numeric columns left")
    return df.select(*[c for c in df.columns if c in names or c in keep])


def exclude_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the named columns; names the table does not have are ignored."""
    return df.drop(*names)


def prefix_columns(df: DataFrame, prefix: str) -> list[str]:
    names = [c for c in df.columns if c.startswith(prefix)]
    if not names:
        raise ValueError(f"no columns start with {prefix!r}")
    return names


def select_prefix(df: DataFrame, prefix: str, keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in prefix_columns(df, prefix) if c not in keep])


def feature_columns(
    df: DataFrame,
    allow_prefixes: list[str],
    ban_exact: list[str] = (),
    ban_substrings: list[str] = ("target",),
) -> list[str]:
    """Columns that start with an allowed prefix and are not banned (leakage guard)."""
    names = [
        c
        for c in df.columns
        if c not in ban_exact
        and not any(s.lower() in c.lower() for s in ban_substrings)
        and any(c.startswith(p) for p in allow_prefixes)
    ]
    if not names:
        raise ValueError(f"no features match {list(allow_prefixes)}")
    return names


def select_features(
    df: DataFrame,
    allow_prefixes: list[str],
    ban_exact: list[str] = (),
    ban_substrings: list[str] = ("target",),
    keep: list[str] = (),
) -> DataFrame:
    return df.select(*keep, *feature_columns(df, allow_prefixes, ban_exact, ban_substrings))


def prefix_plus_columns(
    df: DataFrame, prefix: str, candidates: list[str]
) -> tuple[list[str], list[str]]:
    """Columns with the prefix, and the candidates that exist; each name once."""
    prefixed = [c for c in df.columns if c.startswith(prefix)]
    extra = [c for c in dict.fromkeys(candidates) if c in df.columns and c not in prefixed]
    if not prefixed and not extra:
        raise ValueError(f"no columns start with {prefix!r} and no candidate exists")
    return prefixed, extra


def select_prefix_plus(
    df: DataFrame, prefix: str, candidates: list[str], keep: list[str] = ()
) -> DataFrame:
    prefixed, extra = prefix_plus_columns(df, prefix, candidates)
    return df.select(*keep, *prefixed, *extra)


def validate_numeric(
    df: DataFrame, names: list[str], mode: str = "strict"
) -> tuple[list[str], list[str]]:
    """Split names into (numeric, other). ``strict`` raises on any other, ``report`` returns them."""
    numeric = [n for n in names if is_numeric(df, n)]
    other = [n for n in names if n not in numeric]
    if mode == "strict" and other:
        raise ValueError(f"columns are not numeric: {other[:PREVIEW]}")
    if not numeric:
        raise ValueError("no numeric columns left")
    return numeric, other


def common_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables reduced to the columns they share, in the order of the first."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("the tables have no column in common")
    return a.select(*shared), b.select(*shared)


def column_names(df: DataFrame) -> DataFrame:
    """The column names of a table as a table ``feature`` (as small as its schema)."""
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], "feature string")


def reconcile_features(requested: DataFrame, df: DataFrame | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a feature list that exist as columns of ``df`` (or among names), and those that do not."""
    if isinstance(df, DataFrame):
        available = column_names(df)
    else:
        available = requested.sparkSession.createDataFrame([(n,) for n in df], "feature string")
    return (
        requested.join(available, "feature", "left_semi"),
        requested.join(available, "feature", "left_anti"),
    )


def feature_names(features: DataFrame) -> list[str]:
    """An ordered feature list as names; a list of columns is as small as a schema."""
    return [r.feature for r in features.orderBy("pos").select("feature").collect()]


def require_features(requested: DataFrame, df: DataFrame) -> list[str]:
    """All requested features in order; a missing one is an error."""
    _, missing = reconcile_features(requested, df)
    names = [r.feature for r in missing.orderBy("pos").limit(PREVIEW).collect()]
    if names:
        raise ValueError(f"features missing from the table: {names}")
    return feature_names(requested)


def unpivot(df: DataFrame, ids: list[str], names: list[str], key: str, value: str) -> DataFrame:
    """Long form of numeric columns."""
    wide = df.select(*ids, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(ids, names, key, value)
