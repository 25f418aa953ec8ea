"""Shift labels, logbook hours and lab readings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagloom.functions.timecols import plus_hours

# The spellings of the two shifts, the hour each stands for, and the
# hour used when the label says nothing.
FIRST_SHIFT_LABELS = ("1", "1.0", "i", "1 смена", "смена 1")
SECOND_SHIFT_LABELS = ("2", "2.0", "ii", "2 смена", "смена 2")
FIRST_SHIFT_HOUR = 8
SECOND_SHIFT_HOUR = 20
UNKNOWN_SHIFT_HOUR = 12

# Block names and quality flags of the lab logbook.
NIGHT_BLOCK = "night_20_08"
DAY_BLOCK = "day_08_20"
FLAG_TEXT = "PARTIAL_WITH_TEXT_FLAGS"
FLAG_FULL = "OK_3GROUPS"
FLAG_SINGLE = "PARTIAL_1GROUP"

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def shift_hour(label: Column) -> Column:
    """Hour of day a shift label stands for."""
    text = F.lower(F.trim(label.cast("string")))
    return (
        F.when(text.isin(*FIRST_SHIFT_LABELS), FIRST_SHIFT_HOUR)
        .when(text.isin(*SECOND_SHIFT_LABELS), SECOND_SHIFT_HOUR)
        .when(text.contains("1"), FIRST_SHIFT_HOUR)
        .when(text.contains("2"), SECOND_SHIFT_HOUR)
        .otherwise(UNKNOWN_SHIFT_HOUR)
    )


def proxy_time(date: Column, label: Column) -> Column:
    """Date plus the hour of its shift."""
    return plus_hours(date.cast("date"), shift_hour(label))


def block_of_hour(hour: Column) -> Column:
    return F.when((hour >= 20) | (hour < 8), NIGHT_BLOCK).when(hour.isNotNull(), DAY_BLOCK)


def book_date_of(moment: Column) -> Column:
    """Logbook date: the book of day d runs from 20:00 on d-1 to 20:00 on d."""
    return plus_hours(moment, F.lit(4)).cast("date")


def logbook_times(book_date: Column, time_range: Column) -> dict[str, Column]:
    """Start, end and middle of an ``HH:MM-HH:MM`` logbook range.

    Ranges that start at 20:00 or later belong to the day before the book date.
    """
    ends = F.split(time_range, "-")

    def minutes(text: Column) -> Column:
        hm = F.split(text, ":")
        return hm.getItem(0).try_cast("int") * 60 + hm.getItem(1).try_cast("int")

    first, last = minutes(ends.getItem(0)), minutes(ends.getItem(1))
    length = F.pmod(last - first, F.lit(24 * 60))
    day = book_date.cast("date")
    day = F.when(first >= 20 * 60, F.date_sub(day, 1)).otherwise(day).cast("timestamp_ntz")

    def at(minute: Column) -> Column:
        return day + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))

    return {"start": at(first), "end": at(first + length), "mid": at(first + F.floor(length / 2))}


def event_id(target_key: Column, mid_time: Column) -> Column:
    return F.concat(target_key, F.lit("__"), F.date_format(mid_time, "yyyyMMdd'T'HHmm"))


def is_number(raw: Column) -> Column:
    return F.trim(raw).rlike(NUMBER_PATTERN)


def parse_reading(raw: Column) -> Column:
    """Text that is a number as DOUBLE, anything else as NULL."""
    return F.when(is_number(raw), F.trim(raw).try_cast("double"))


def text_flags(raws: list[Column]) -> Column:
    """Distinct non-numeric readings in column order, joined with ``"; "``; NULL if none."""
    texts = F.array_compact(
        F.array(*[F.when((F.trim(r) != "") & ~is_number(r), F.trim(r)) for r in raws])
    )
    return F.when(F.size(texts) > 0, F.array_join(F.array_distinct(texts), "; "))


def valid_count(values: list[Column]) -> Column:
    return sum((v.isNotNull().cast("int") for v in values), F.lit(0))


def row_mean(values: list[Column]) -> Column:
    """Mean over the non-null values of a row, NULL if there are none."""
    total = sum((F.coalesce(v.cast("double"), F.lit(0.0)) for v in values), F.lit(0.0))
    n = valid_count(values)
    return F.when(n > 0, total / n)


def quality_flag(flags: Column, n_valid: Column) -> Column:
    return (
        F.when(flags.isNotNull(), FLAG_TEXT)
        .when(n_valid == 3, FLAG_FULL)
        .when(n_valid == 1, FLAG_SINGLE)
    )
