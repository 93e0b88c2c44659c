"""Trip durations: day-time intervals and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SECONDS_ONLY = T.DayTimeIntervalType(T.DayTimeIntervalType.SECOND, T.DayTimeIntervalType.SECOND)


def elapsed_seconds(interval: Column) -> Column:
    """A day-time interval as a double number of seconds."""
    return interval.cast(_SECONDS_ONLY).cast("decimal(18,6)").cast("double")


def interval_from_seconds(seconds: Column) -> Column:
    """The inverse of :func:`elapsed_seconds`."""
    return F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def between_timestamps(start: Column, end: Column) -> Column:
    """The day-time interval from ``start`` to ``end`` (both without time zone)."""
    return (end - start).cast(T.DayTimeIntervalType())
