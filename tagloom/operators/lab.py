"""Lab logbook samples, shift aggregates and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tagloom.functions import labels
from tagloom.functions.timecols import time_bucket


def lab_samples(
    raw: DataFrame,
    target_key: str,
    raw_cols: Sequence[str],
    book_date: str = "book_date",
    time_range: str = "time_range",
) -> DataFrame:
    """Derived columns of a logbook table.

    From the book date, the hour range and the raw readings: block, assumed start, end and middle
    time, event id, parsed readings, count of valid ones, mean, quality flag and text flags.
    """
    times = labels.logbook_times(F.col(book_date), F.col(time_range))
    timed = raw.withColumns({f"timestamp_{k}": c for k, c in times.items()})
    parsed = {f"{c}_value": labels.parse_reading(F.col(c)) for c in raw_cols}
    values = [F.col(c) for c in parsed]
    return (
        timed.withColumns(
            {
                "block": labels.block_of_hour(F.hour("timestamp_start")),
                "event_id": labels.event_id(F.lit(target_key), F.col("timestamp_mid")),
                "manual_text_flags": labels.text_flags([F.col(c) for c in raw_cols]),
                **parsed,
            }
        )
        .withColumns(
            {"valid_groups_count": labels.valid_count(values), "value_mean": labels.row_mean(values)}
        )
        .withColumn(
            "quality_flag",
            labels.quality_flag(F.col("manual_text_flags"), F.col("valid_groups_count")),
        )
    )


def _flag_counts():
    flag = F.col("quality_flag")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(flag == labels.FLAG_FULL).alias("ok_3groups"),
        F.count_if(flag == labels.FLAG_SINGLE).alias("partial_1group"),
        F.count_if(flag == labels.FLAG_TEXT).alias("partial_with_text_flags"),
    ]


def quality_by_day(lab: DataFrame, mid: str = "timestamp_mid") -> DataFrame:
    """Samples per calendar day of their middle time, by quality flag."""
    return lab.groupBy(F.col(mid).cast("date").alias("date")).agg(*_flag_counts())


def quality_by_part(
    lab: DataFrame, ranges: Sequence[tuple[str, str, str]], mid: str = "timestamp_mid"
) -> DataFrame:
    """Samples and time span per named date range ``(part, from, to)``, both days included.

    The ranges are a short argument list, so they become a part label and no join is needed.
    A day in several ranges counts in each.
    """
    day = F.col(mid).cast("date")
    inside = [
        F.when(
            day.between(F.lit(a).cast("date"), F.lit(b).cast("date")),
            F.struct(
                F.lit(name).alias("part"),
                F.lit(a).cast("date").alias("date_from"),
                F.lit(b).cast("date").alias("date_to"),
            ),
        )
        for name, a, b in ranges
    ]
    parts = lab.withColumn("_p", F.explode(F.array_compact(F.array(*inside))))
    return parts.groupBy(F.col("_p.part"), F.col("_p.date_from"), F.col("_p.date_to")).agg(
        *_flag_counts(), F.min(mid).alias("min_timestamp"), F.max(mid).alias("max_timestamp")
    )


def distinct_per_group(df: DataFrame, group: str, col: str, name: str = "unique_values") -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(col).alias(name))


def list_per_day(df: DataFrame, day: str, label: str, name: str = "labels") -> DataFrame:
    """Sorted distinct labels of a day joined with ``"; "``.

    Meant for block names and clock times, of which a day only has so many; they are made
    distinct before anything is gathered.
    """
    distinct = df.select(day, label).where(F.col(label).isNotNull()).distinct()
    gathered = F.array_join(F.sort_array(F.collect_list(label)), "; ")
    return distinct.groupBy(day).agg(gathered.alias(name))


def shift_features(
    sensor: DataFrame, tag: str = "tag", time: str = "ts", value: str = "value"
) -> DataFrame:
    """Mean, deviation, min and max of hourly means per logbook date, block and tag."""
    hour = time_bucket(sensor, time, 60)
    hourly = sensor.groupBy(tag, hour.alias("_hour")).agg(F.avg(value).alias("_v"))
    return hourly.groupBy(
        labels.book_date_of(F.col("_hour")).alias("book_date"),
        labels.block_of_hour(F.hour("_hour")).alias("block"),
        tag,
    ).agg(
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )


def pivot_shift_features(
    features: DataFrame,
    tags: Sequence[str],
    stats: Sequence[str] = ("mean", "std", "min", "max"),
    *,
    prefix: str,
    tag: str = "tag",
) -> DataFrame:
    """One row per shift, columns ``{prefix}_{tag}_{stat}``."""
    cell = F.struct(*stats)
    wide = features.groupBy("book_date", "block").pivot(tag, list(tags)).agg(F.max(cell))
    return wide.select(
        "book_date",
        "block",
        *[F.col(f"`{t}`.{s}").alias(f"{prefix}_{t}_{s}") for t in tags for s in stats],
    )


def merge_shift(lab: DataFrame, sensor: DataFrame, on: Sequence[str] = ("book_date", "block")) -> DataFrame:
    """Lab rows with the sensor columns of their shift; lab rows without one are kept.

    The sensor side has one row per shift. Which side is broadcast, and splitting a shift that
    holds many lab rows, is left to the adaptive planner, which sees the real sizes.
    """
    return lab.join(sensor, list(on), "left")
