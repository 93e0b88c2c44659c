"""Key figures of a calendar window, and their change from period to period.

The calendar is preserved: a month without trips counts as zero. The fact table is aggregated to
one row per day key first, so the calendar join never shuffles trips.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions.measures import finished, merge_parts
from farelens.functions.periods import period_start
from farelens.operators.scope import Years, days_in, trips_in
from farelens.plans.reports import per_key, volume_measures
from farelens.sources.schema import TripTables


def _calendar_periods(
    tables: TripTables,
    period: str,
    names: Collection[str],
    stable: bool,
    years: Years = None,
    from_month: int = 1,
) -> DataFrame:
    """``(date, last_day, trip_count, parts...)`` per period of the calendar window."""
    measures = {name: value for name, value in volume_measures().items() if name in names}
    trips = per_key(trips_in(tables, years, from_month), ["pickup_date_key"], measures, stable)
    days = days_in(tables, years, from_month).select(
        F.col("date_key").alias("pickup_date_key"), "full_date"
    )
    return (
        days.join(trips, "pickup_date_key", "left")
        .groupBy(period_start(F.col("full_date"), period).alias("date"))
        .agg(
            F.max("full_date").alias("last_day"),
            F.coalesce(F.sum("trip_count"), F.lit(0)).alias("trip_count"),
            *merge_parts(trips),
        )
    )


def kpi_window_totals(
    tables: TripTables,
    *,
    year: int = 2024,
    from_month: int = 10,
    as_of: Column | None = None,
    stable: bool = False,
) -> DataFrame:
    """One row: the window's last calendar day, its trips and their mean total.

    Without any calendar day the date is ``as_of`` (default: today) and the figures are 0.
    """
    months = _calendar_periods(tables, "month", ["avg_total_amount"], stable, [year], from_month)
    totals = months.agg(
        F.coalesce(F.max("last_day"), _today(as_of)).alias("date"),
        F.coalesce(F.sum("trip_count"), F.lit(0)).alias("trip_count"),
        *merge_parts(months),
    )
    return finished(totals, ["avg_total_amount"])


def kpi_busiest_month(
    tables: TripTables,
    *,
    year: int = 2024,
    from_month: int = 10,
    as_of: Column | None = None,
    stable: bool = False,
) -> DataFrame:
    """One row: the month with most trips in the window (the first of equals) and its means.

    Without any calendar day it is the month of ``as_of`` (default: today) with figures of 0.
    """
    names = list(volume_measures())
    months = _calendar_periods(tables, "month", names, stable, [year], from_month)
    month = finished(months.drop("last_day"), names)
    earliest_first = -F.unix_date("date")
    best = month.agg(
        F.max_by(F.struct(*month.columns), F.struct(F.col("trip_count"), earliest_first)).alias("best")
    )
    return best.select(
        F.coalesce("best.date", F.trunc(_today(as_of), "month")).alias("date"),
        F.coalesce("best.trip_count", F.lit(0)).alias("trip_count"),
        *[F.coalesce(F.col("best")[name], F.lit(0.0)).alias(name) for name in names],
    )


def kpi_trends(
    tables: TripTables,
    *,
    year: int = 2024,
    from_month: int = 10,
    months: int = 3,
    stable: bool = False,
) -> DataFrame:
    """One row of four ``{current, previous, trend}`` records for a year from ``from_month`` on.

    ``previous`` and ``trend`` are always 0.0 here; :func:`kpi_period_trend` computes real ones.
    The mean per month divides by ``months`` whatever the calendar holds.
    """
    by_month = _calendar_periods(tables, "month", ["avg_total_amount"], stable, [year], from_month)
    totals = by_month.agg(
        F.coalesce(F.sum("trip_count"), F.lit(0)).cast("double").alias("total"),
        F.coalesce(F.max("trip_count"), F.lit(0)).cast("double").alias("busiest"),
        *merge_parts(by_month),
    )
    totals = finished(totals, ["avg_total_amount"])
    current = {
        "total_trips": F.col("total"),
        "avg_trips_per_period": F.col("total") / F.lit(float(months)),
        "max_trips_per_period": F.col("busiest"),
        "avg_amount_overall": F.col("avg_total_amount"),
    }
    return totals.select(
        *[
            F.struct(
                value.alias("current"), F.lit(0.0).alias("previous"), F.lit(0.0).alias("trend")
            ).alias(name)
            for name, value in current.items()
        ]
    )


def kpi_period_trend(
    tables: TripTables,
    *,
    period: str = "month",
    years: Years = None,
    stable: bool = False,
) -> DataFrame:
    """Trips and mean total per calendar period, with the previous period's and the change in %.

    The change is NULL where the previous figure is missing or 0. ``years`` keeps the periods that
    start in those years; their first period is still compared with the one before.
    """
    needed = sorted({y for year in years or () for y in (year - 1, year, year + 1)})
    periods = _calendar_periods(tables, period, ["avg_total_amount"], stable, needed)
    rows = finished(periods.drop("last_day"), ["avg_total_amount"])
    by_date = Window.orderBy("date")
    for name in ("trip_count", "avg_total_amount"):
        previous = F.col(f"previous_{name}")
        rows = rows.withColumn(f"previous_{name}", F.lag(name).over(by_date)).withColumn(
            f"{name}_trend", (F.col(name) - previous) * 100.0 / F.nullif(previous, F.lit(0))
        )
    if years:
        rows = rows.where(F.year("date").isin(*years))
    return rows.orderBy("date")


def _today(as_of: Column | None) -> Column:
    return F.current_date() if as_of is None else as_of.cast("date")
