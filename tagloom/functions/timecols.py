"""Time arithmetic on TIMESTAMP_NTZ, TIMESTAMP and DATE columns.

Nothing here depends on the session time zone for zone-less columns.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def order_key(df: DataFrame, name: str) -> Column:
    """The column as a number that sorts the same way (times become microseconds)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return (
            F.unix_date(c.cast("date")).cast("long") * F.lit(MICROS_PER_DAY)
            + F.hour(c).cast("long") * F.lit(MICROS_PER_HOUR)
            + F.minute(c).cast("long") * F.lit(MICROS_PER_MINUTE)
            + (F.extract(F.lit("SECOND"), c) * MICROS_PER_SECOND).cast("long")
        )
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(MICROS_PER_DAY)
    if isinstance(dtype, T.IntegralType):
        return c.cast("long")
    if isinstance(dtype, T.DecimalType):
        return c
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    raise TypeError(f"order key {name!r} must be numeric, date or timestamp, not {dtype.simpleString()}")


def key_literal(dtype: T.DataType, key) -> Column:
    """Inverse of order_key for one value: a constant comparable with the raw column."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        moment = datetime(1970, 1, 1) + timedelta(microseconds=int(key))
        if isinstance(dtype, T.DateType):
            return F.lit(moment.date())
        if isinstance(dtype, T.TimestampNTZType):
            return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.timestamp_micros(F.lit(int(key)))
    return F.lit(key).cast(dtype)


def ntz_from_micros(micros: Column) -> Column:
    seconds = micros.cast("decimal(20,0)") / F.lit(MICROS_PER_SECOND)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def floor_div(value: Column, width: int) -> Column:
    """Floor division for long columns, also below zero."""
    w = F.lit(int(width)).cast("long")
    return ((value - F.pmod(value, w)) / w).cast("long")


def time_bucket(df: DataFrame, time_col: str, step_minutes: int) -> Column:
    """Start of the fixed-width step a time falls into, as TIMESTAMP_NTZ."""
    width = step_minutes * MICROS_PER_MINUTE
    return ntz_from_micros(floor_div(order_key(df, time_col), width) * F.lit(width))


def plus_hours(moment: Column, hours: Column) -> Column:
    return moment.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours.cast("int"))


def coerce_timestamp(df: DataFrame, name: str) -> DataFrame:
    """Parse text to TIMESTAMP_NTZ; text that is not a time becomes NULL."""
    return df.withColumn(name, F.col(name).try_cast("timestamp_ntz"))
