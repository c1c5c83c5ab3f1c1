"""Calendar periods: starts, labels and spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.numeric import column, column_type, is_text, is_time

GRANULARITIES = ("day", "week", "month", "quarter", "year")


def check_granularity(granularity: str) -> str:
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity {granularity!r} is not one of {GRANULARITIES}")
    return granularity


def as_timestamp(df: DataFrame, name: str, formats: tuple[str, ...] = ()) -> Column:
    """The column as a wall-clock timestamp; null where it holds no usable date.

    Text may be any form that Spark's own cast reads (``2024``, ``2024-01``, ``2024-01-31``, with
    or without a time), or one of the extra ``formats``.
    """
    data_type = column_type(df, name)
    col = column(name)
    if is_text(data_type):
        parsed = F.coalesce(F.try_to_timestamp(col), *[F.try_to_timestamp(col, F.lit(f)) for f in formats])
        stamp = parsed.cast("timestamp_ntz")
    elif isinstance(data_type, T.TimestampNTZType):
        stamp = col
    elif is_time(data_type):
        stamp = col.cast("timestamp_ntz")
    else:
        raise ValueError(f"column {name!r} of type {data_type.simpleString()} holds no dates")
    return stamp


def period_start(stamp: Column, granularity: str) -> Column:
    """First day of the period, as a date. Weeks start on Monday."""
    check_granularity(granularity)
    if granularity == "day":
        return F.to_date(stamp)
    return F.to_date(F.date_trunc(granularity, stamp))


def resample_start(stamp: Column, granularity: str) -> Column:
    """Date that stands for the period in a series: the day, the closing Sunday, the month start."""
    start = period_start(stamp, granularity)
    return F.date_add(start, 6) if granularity == "week" else start


def period_label(stamp: Column, granularity: str) -> Column:
    """``2024-01-31``, ``2024-W05`` (ISO), ``2024-01``, ``2024Q1`` or ``2024``."""
    check_granularity(granularity)
    if granularity == "day":
        return F.date_format(stamp, "yyyy-MM-dd")
    if granularity == "week":
        iso_year = F.extract(F.lit("YEAROFWEEK"), stamp).cast("string")
        return F.concat(iso_year, F.lit("-W"), F.lpad(F.weekofyear(stamp).cast("string"), 2, "0"))
    if granularity == "month":
        return F.date_format(stamp, "yyyy-MM")
    if granularity == "quarter":
        return F.concat(F.year(stamp).cast("string"), F.lit("Q"), F.quarter(stamp).cast("string"))
    return F.date_format(stamp, "yyyy")


def period_range_label(stamp: Column, granularity: str) -> Column:
    """As ``period_label``, but a week reads ``Monday/Sunday``."""
    if granularity != "week":
        return period_label(stamp, granularity)
    monday = period_start(stamp, "week")
    return F.concat(
        F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd")
    )


def spine(first: Column, last: Column, granularity: str) -> Column:
    """Array of every period between two period dates of the same granularity."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[granularity]
    return F.sequence(first, last, F.expr(step))
