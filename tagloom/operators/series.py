"""Lags, rolling means, horizon labels and resampling of ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagloom.functions.timecols import MICROS_PER_MINUTE, floor_div, ntz_from_micros, order_key, time_bucket
from tagloom.operators.columns import exclude_columns
from tagloom.operators.ranks import MAX_GROUP_ROWS, over_series
from tagloom.operators.scans import carried_hits

GRID_BLOCK = 1024  # steps of a group that are laid out and scanned together

# The six signals that get temporal features, their lags and rolling widths.
TEMPORAL_SIGNALS = (
    "temp_offgas_k1",
    "gas_flow_in1_k1",
    "gas_flow_in2_k1",
    "gas_header_pressure_1",
    "gas_header_pressure_2",
    "fg_header_pressure",
)
TEMPORAL_LAGS = (1, 2)
TEMPORAL_WINDOWS = (3,)


def _lag_columns(names, lags):
    def build(w):
        return {f"{c}_lag{k}": F.lag(c, k).over(w) for c in names for k in lags}

    return build


def _rolling_columns(names, windows):
    def build(w):
        out = {}
        for c in names:
            for n in windows:
                frame = w.rowsBetween(-(n - 1), 0)
                full = F.count(c).over(frame) == n
                out[f"{c}_roll{n}_mean"] = F.when(full, F.avg(c).over(frame))
        return out

    return build


def add_lags(
    df: DataFrame,
    cols: list[str],
    lags: list[int],
    order: list[str],
    partition: list[str] = (),
    **limits,
) -> DataFrame:
    """Add ``{col}_lag{k}``; names the table does not have are skipped."""
    known = [c for c in cols if c in df.columns]
    if not known:
        return df
    return over_series(
        df, list(partition), order, _lag_columns(known, lags), lookback=max(lags), **limits
    )


def add_rolling_mean(
    df: DataFrame,
    cols: list[str],
    windows: list[int],
    order: list[str],
    partition: list[str] = (),
    **limits,
) -> DataFrame:
    """Add ``{col}_roll{n}_mean``, null unless all n values are there."""
    known = [c for c in cols if c in df.columns]
    if not known:
        return df
    return over_series(
        df,
        list(partition),
        order,
        _rolling_columns(known, windows),
        lookback=max(windows) - 1,
        **limits,
    )


def temporal_features(
    df: DataFrame,
    order: list[str],
    partition: list[str] = (),
    signals: tuple[str, ...] = TEMPORAL_SIGNALS,
    lags: tuple[int, ...] = TEMPORAL_LAGS,
    windows: tuple[int, ...] = TEMPORAL_WINDOWS,
    exclude: list[str] = (),
    exclude_before_lags: bool = True,
    **limits,
) -> DataFrame:
    """Lags and rolling means of the default signals in one window.

    Pass ``partition=[..., "part"]`` to compute them inside train and test separately. With
    ``exclude_before_lags`` an excluded signal loses its lags too; otherwise only the signal
    itself is dropped.
    """
    source = exclude_columns(df, list(exclude)) if exclude_before_lags else df
    known = [c for c in signals if c in source.columns]
    if known:

        def build(w):
            return {**_lag_columns(known, lags)(w), **_rolling_columns(known, windows)(w)}

        source = over_series(
            source,
            list(partition),
            order,
            build,
            lookback=max([*lags, *[n - 1 for n in windows]]),
            **limits,
        )
    return source if exclude_before_lags else exclude_columns(source, list(exclude))


def add_horizon_label(
    df: DataFrame,
    col: str,
    h: int,
    order: list[str],
    partition: list[str] = (),
    name: str = "target",
    **limits,
) -> DataFrame:
    """Label: the value of a signal ``h`` steps ahead (null for the last ``h`` rows)."""

    def build(w):
        return {name: F.lead(col, h).over(w)}

    return over_series(df, list(partition), order, build, lookahead=h, **limits)


RESAMPLE_STATS = ("mean", "std", "min", "max", "last")


def resample(
    df: DataFrame,
    time_col: str,
    value: str,
    step_minutes: int = 6,
    group: list[str] = (),
    row_id: str | None = None,
    stats: tuple[str, ...] = RESAMPLE_STATS,
) -> DataFrame:
    """Fixed-step table: one row per group and step with the chosen statistics."""
    v = F.col(value)
    newest = F.struct(order_key(df, time_col), *([F.col(row_id)] if row_id else []))
    known = {
        "mean": F.avg(v),
        "std": F.stddev_samp(v),
        "min": F.min(v),
        "max": F.max(v),
        "last": F.max_by(v, F.when(v.isNotNull(), newest)),
    }
    step = time_bucket(df, time_col, step_minutes).alias("step")
    return df.groupBy(*group, step).agg(*[known[s].alias(s) for s in stats])


def resample_filled(
    df: DataFrame,
    time_col: str,
    value: str,
    step_minutes: int = 6,
    group: list[str] = (),
    row_id: str | None = None,
    stats: tuple[str, ...] = RESAMPLE_STATS,
    carry: tuple[str, ...] = ("last",),
) -> DataFrame:
    """``resample`` with the empty steps between a group's first and last one, so that a lag by rows is a lag by time.

    Empty steps have ``empty`` set and null statistics; those named in ``carry`` take the last known value of the
    steps before, however far back. A group is laid out in blocks of ``GRID_BLOCK`` steps: a row per block is made
    first and the block's steps from it, a window carries values inside a block only, and blocks pass on one value each,
    so neither a long gap nor a long series lands in one task. Rows without a time are a step of their own (null), as they are
    in ``resample``; a null group is a group.
    """
    width = step_minutes * MICROS_PER_MINUTE
    rows = resample(df, time_col, value, step_minutes, group, row_id, stats)
    # Groups by texts that tell null apart, as joins do not match nulls.
    named = [F.when(F.col(g).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(g).cast("string"))) for g in group]
    key = (F.to_json(F.array(*named)) if named else F.lit("")).alias("_g")
    known = rows.select("*", key, floor_div(order_key(rows, "step"), width).alias("_k"))
    ends = known.where("_k IS NOT NULL").groupBy(*group, "_g").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    blocks = ends.withColumn("_b", F.explode(F.sequence(floor_div(F.col("_first"), GRID_BLOCK), floor_div(F.col("_last"), GRID_BLOCK))))
    start = F.col("_b") * F.lit(GRID_BLOCK)
    inside = F.sequence(F.greatest("_first", start), F.least("_last", start + F.lit(GRID_BLOCK - 1)))
    grid = blocks.withColumn("_k", F.explode(inside)).select(*group, "_g", "_k")
    filled = grid.unionByName(known.withColumn("_some", F.lit(True)), allowMissingColumns=True)
    # One row of each step at most has statistics, so their maximum is that row's value.
    filled = filled.groupBy("_g", "_k").agg(
        *[F.first(g, ignorenulls=True).alias(g) for g in group], *[F.max(s).alias(s) for s in stats], F.max("_some").isNull().alias("empty")
    )
    filled = filled.withColumn("_b", floor_div(F.col("_k"), GRID_BLOCK))
    names = [c for c in carry if c in stats]
    so_far = Window.partitionBy("_g", "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = filled.withColumns({f"_{c}": F.last(c, ignorenulls=True).over(so_far) for c in names})
    for c in names:
        hit = F.struct("_k", F.col(c).alias("_v"))
        newest = filled.where(F.col(c).isNotNull() & F.col("_b").isNotNull()).groupBy("_g", "_b").agg(F.max(hit).alias("hit"))
        asked = filled.where(F.col(f"_{c}").isNull() & F.col("_b").isNotNull()).select("_g", "_b").distinct()
        before = carried_hits(newest, asked, ["_g"], "_b").select("_g", "_b", F.col("hit._v").alias(f"_far_{c}"))
        filled = filled.join(before, ["_g", "_b"], "left").withColumn(c, F.coalesce(f"_{c}", f"_far_{c}"))
    step = ntz_from_micros(F.col("_k") * F.lit(width)).alias("step")
    return filled.select(*group, step, *stats, "empty")


__all__ = [
    "MAX_GROUP_ROWS",
    "add_horizon_label",
    "add_lags",
    "add_rolling_mean",
    "resample",
    "resample_filled",
    "temporal_features",
]
