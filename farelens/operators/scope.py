"""Restrict trips and calendar days to years and months of the pickup date.

The pickup date is the calendar day of ``pickup_date_key``, the same day the dated reports show.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.sources.schema import MONTH_PARTITION, TripTables

Years = Collection[int] | None


def days_in(tables: TripTables, years: Years = None, from_month: int = 1) -> DataFrame:
    """Calendar days in the given years (none: all) from a month of the year on."""
    return _within(tables.dim_date, "year", "month", years, from_month)


def trips_in(tables: TripTables, years: Years = None, from_month: int = 1) -> DataFrame:
    """Trips picked up on those days.

    A stored fact table is pruned by its month partitions. Any other is semi-joined to the days,
    which are few enough for Spark to broadcast when it knows the calendar's size.
    """
    fact = tables.fact_trips
    if not years and from_month <= 1:
        return fact
    if set(MONTH_PARTITION.names) <= set(fact.columns):
        return _within(fact, *MONTH_PARTITION.names, years, from_month)
    keys = days_in(tables, years, from_month).select(F.col("date_key").alias("pickup_date_key"))
    return fact.join(keys, "pickup_date_key", "left_semi")


def _within(df: DataFrame, year: str, month: str, years: Years, from_month: int) -> DataFrame:
    if years:
        df = df.where(F.col(year).isin(*years))
    return df.where(F.col(month) >= from_month) if from_month > 1 else df
