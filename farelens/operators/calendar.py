"""Calendar dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.sources.schema import DIM_DATE, conform


def date_key(date: Column) -> Column:
    """The key of a day: its yyyymmdd digits as an integer."""
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day from ``start`` to ``end``, both included."""
    bounds = spark.range(1).select(F.lit(start).alias("first_day"), F.lit(end).alias("last_day"))
    return _days_between(bounds)


def calendar_of(df: DataFrame, date_column: str) -> DataFrame:
    """One row per day from the earliest to the latest value of a date or timestamp column."""
    day = F.col(date_column).cast("date")
    return _days_between(df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")))


def _days_between(bounds: DataFrame) -> DataFrame:
    full_date = F.col("full_date")
    iso_day = F.weekday(full_date) + 1
    days = (
        bounds.where(F.col("first_day") <= F.col("last_day"))
        .select(F.explode(F.sequence("first_day", "last_day")).alias("full_date"))
        .select(
            date_key(full_date).alias("date_key"),
            full_date,
            F.year(full_date).alias("year"),
            F.month(full_date).alias("month"),
            F.dayofmonth(full_date).alias("day"),
            iso_day.alias("day_of_week"),
            F.date_format(full_date, "EEEE").alias("day_name"),
            F.date_format(full_date, "MMMM").alias("month_name"),
            F.quarter(full_date).alias("quarter"),
            (iso_day >= 6).alias("is_weekend"),
        )
    )
    return conform(days, DIM_DATE)
