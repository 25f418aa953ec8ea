"""Regression metrics, summaries, comparisons and residual tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tagloom.operators.ranks import group_index

METRICS = ("mae", "rmse", "r2")

# How model names are shown; a name without an entry is shown as it is.
DISPLAY_NAMES = {
    "ridge": "Ridge",
    "random_forest": "Random Forest",
    "gradient_boosting": "Gradient Boosting",
}


def regression_metrics(
    predictions: DataFrame,
    group: Sequence[str] = (),
    y_true: str = "y_true",
    y_pred: str = "y_pred",
) -> DataFrame:
    """MAE, RMSE and R2 per group in one aggregate.

    R2 of a constant truth is 1 for a perfect fit, else 0.
    """
    y, e = F.col(y_true), F.col(y_true) - F.col(y_pred)
    pairs = predictions.where(y.isNotNull() & F.col(y_pred).isNotNull())
    sums = pairs.groupBy(*group).agg(
        F.count(y).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("_mse"),
        F.var_pop(y).alias("_var"),
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).otherwise(
        F.when(F.col("_mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select(*group, "n", "mae", F.sqrt("_mse").alias("rmse"), r2.alias("r2"))


def fold_summary(folds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of every metric over the folds."""
    return folds.groupBy(*group).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in METRICS],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in METRICS],
    )


def stability_verdict(folds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """stable / conditional / weak for 0 / 1 / more folds with negative R2."""
    counted = folds.groupBy(*group).agg(
        F.count("r2").alias("n_folds"), F.count_if(F.col("r2") < 0).alias("negative_r2")
    )
    bad = F.col("negative_r2")
    verdict = F.when(bad == 0, "stable").when(bad == 1, "conditional").otherwise("weak")
    return counted.withColumn("verdict", verdict)


def delta_vs_baseline(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of RMSE and R2 against one stored baseline row, and whether it is not worse.

    With ``params`` on both sides, ``same_params`` tells whether the comparison mixes settings.
    """
    stored = baseline.limit(2).collect()
    if len(stored) != 1:
        raise ValueError("the baseline must be exactly one row")
    base = stored[0].asDict()
    out = metrics.withColumns(
        {
            "delta_rmse": F.col("rmse") - F.lit(base["rmse"]),
            "delta_r2": F.col("r2") - F.lit(base["r2"]),
        }
    ).withColumn("not_worse", (F.col("delta_rmse") <= 0) & (F.col("delta_r2") >= 0))
    if "params" in base and "params" in metrics.columns:
        out = out.withColumn("same_params", F.col("params").eqNullSafe(F.lit(base["params"])))
    return out


def wide_summary(metrics: DataFrame, experiment: list[str], models: dict[str, str]) -> DataFrame:
    """One row per experiment with ``{short}_mae .. {short}_r2`` for every model.

    ``models`` maps model names to the short names used in columns; a missing model gives nulls.
    """
    wide = (
        metrics.groupBy(*experiment)
        .pivot("model", list(models))
        .agg(F.max(F.struct(*METRICS)))
    )
    return wide.select(
        *experiment,
        *[F.col(f"`{k}`.{m}").alias(f"{s}_{m}") for k, s in models.items() for m in METRICS],
    )


def comparison_table(base: DataFrame, variants: DataFrame, baseline: DataFrame) -> DataFrame:
    """Base row and variant rows together, each with its change against the baseline."""
    return delta_vs_baseline(base.unionByName(variants, allowMissingColumns=True), baseline)


def run_sizes(df: DataFrame, n_features: int, group: Sequence[str] = ()) -> DataFrame:
    part = F.col("part")
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_features).cast("long").alias("n_features"),
        F.count_if(part == "train").alias("train_size"),
        F.count_if(part == "test").alias("test_size"),
    )


def accept_gate(metrics: DataFrame, r2_min: float) -> DataFrame:
    return metrics.withColumn("accepted", F.col("r2") > F.lit(r2_min))


def display_name(metrics: DataFrame, model: str = "model") -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv])
    return metrics.withColumn("model_display_name", F.coalesce(names[F.col(model)], F.col(model)))


def metric_long(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """One row per metric, for charts."""
    return metrics.unpivot(ids, list(METRICS), "metric", "metric_value")


def column_profile(df: DataFrame) -> DataFrame:
    """Name, type, null count and share, smallest and largest value of every column.

    One aggregate over the table, turned into rows afterwards.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs += [
            F.count_if(c.isNull()).alias(f"_null{i}"),
            F.min(c).cast("string").alias(f"_min{i}"),
            F.max(c).cast("string").alias(f"_max{i}"),
        ]
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.col(f"_null{i}").alias("null_count"),
            (F.col(f"_null{i}") / F.nullif(F.col("_n"), F.lit(0))).alias("null_share"),
            F.col(f"_min{i}").alias("min_value"),
            F.col(f"_max{i}").alias("max_value"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables below each other, columns matched by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def residuals(predictions: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    r = F.col(y_true) - F.col(y_pred)
    return predictions.withColumns({"residual": r, "abs_err": F.abs(r)})


def residual_histogram(predictions: DataFrame, bins: int = 10, value: str = "residual") -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest residual.

    Every bin is listed, also empty ones; the largest value belongs to the last bin.
    """
    v = F.col(value)
    rows = predictions.where(v.isNotNull())
    lo, hi = rows.agg(F.min(v), F.max(v)).first()
    spark = predictions.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin long, bin_from double, bin_to double, n long")
    width = (hi - lo) / bins
    place = F.lit(0).cast("long") if width == 0 else F.floor((v - F.lit(lo)) / F.lit(width))
    counted = rows.groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(
        F.count(v).alias("n")
    )
    edges = spark.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("bin_from"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("bin_to"),
    )
    return edges.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def test_series(
    predictions: DataFrame, order: list[str], group: Sequence[str] = ("target", "model"), **limits
) -> DataFrame:
    """Actual against predicted with a test index 0..n-1 per target and model."""
    indexed = group_index(predictions, list(group), order, "_i", **limits)
    return indexed.withColumn("test_index", F.col("_i") - 1).drop("_i")


test_series.__test__ = False  # a table, not a test case


