"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

BOM = "﻿"


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    name: str | None = None,
) -> DataFrame:
    """Read a CSV (header, types inferred unless ``schema`` is given), Parquet or JSON table.

    ``name`` picks one table of a folder that holds several. A missing path is an error.
    """
    location = path if name is None else f"{path.rstrip('/')}/{name}.{fmt}"
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", False)
        if schema is None:
            reader = reader.option("inferSchema", True).option("preferDate", True)
    try:
        df = reader.load(location)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no table at {location}") from e
        raise
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip(BOM)) if first.startswith(BOM) else df


def ordered_distinct(df: DataFrame, name: str, position: str) -> DataFrame:
    """Distinct non-null values of ``name`` with the position each first appears at."""
    return (
        df.where(F.col(name).isNotNull())
        .groupBy(F.col(name).cast("string").alias(name))
        .agg(F.min(position).alias(position))
    )


def load_feature_list(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Ordered feature list ``(pos, feature)`` from a file with a ``feature`` column.

    Nulls are dropped and duplicates keep their first position. A list names columns, so it
    is as small as a schema; an explicit ``pos`` column is used when the file has one.
    """
    df = read_table(spark, path, fmt)
    if "feature" not in df.columns:
        raise ValueError(f"no column 'feature' in {path}")
    if "pos" not in df.columns:
        df = df.coalesce(1).withColumn("pos", F.monotonically_increasing_id())
    features = ordered_distinct(df, "feature", "pos").select("pos", "feature")
    if features.isEmpty():
        raise ValueError(f"feature list {path} is empty")
    return features
