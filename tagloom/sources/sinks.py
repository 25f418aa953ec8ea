"""Writers for metrics, run logs, predictions, models and run documents."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import Column, DataFrame, functions as F


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    _write(metrics, path, fmt, mode)


def write_run_log(metrics: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Metrics plus ``run_date`` (ISO time, seconds); appends to the log by default."""
    run_date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    _write(metrics.withColumn("run_date", run_date), path, fmt, mode)


def write_predictions(
    predictions: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    _write(predictions, path, fmt, mode)


def save_model(model, path: str, tag: str, name: str) -> str:
    """Save one fitted model per configuration under ``path/tag_name``.

    Spark ML's models become a pipeline, which ``load_model`` reads; others save themselves and are read by their class.
    """
    target = f"{path.rstrip('/')}/{tag}_{name}"
    if isinstance(model, Transformer):
        PipelineModel([model]).write().overwrite().save(target)
    else:
        model.save(target)
    return target


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_info(
    fold_metrics: DataFrame, settings: dict[str, Column | str | int | float], summary: DataFrame
) -> DataFrame:
    """One row per run: its settings, its folds as an array in fold order, its summary.

    ``fold_metrics`` has one row per fold, so the array is as long as the fold count.
    """
    folds = F.array_sort(F.collect_list(F.struct(*fold_metrics.columns)))
    totals = summary.first().asDict()
    header = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in settings.items()]
    whole = F.struct(*[F.lit(v).alias(k) for k, v in totals.items()])
    return fold_metrics.agg(folds.alias("folds")).select(*header, "folds", whole.alias("summary"))


def write_run_info(info: DataFrame, path: str, mode: str = "overwrite") -> None:
    info.write.mode(mode).json(path)
