"""Dates, instants and date ranges (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def event_instant(day: Column, hour: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)


def hour_start(instant: Column) -> Column:
    """``date_trunc`` yields a zoned timestamp; the cast brings it back to the zone-free type."""
    return F.date_trunc("hour", instant).cast("timestamp_ntz")


def week_start(day: Column) -> Column:
    """The Monday on or before ``day``."""
    return F.date_trunc("week", day).cast("date")


def days_in_month(day: Column) -> Column:
    return F.day(F.last_day(day))
