"""Calendar periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month", "quarter", "year")


def period_start(date: Column, period: str) -> Column:
    """First day of the period that contains ``date``; weeks start on Monday."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; use one of {PERIODS}")
    return date if period == "day" else F.trunc(date, period)
