"""Roll-ups and chart series computed from finished reports (daily volume, hourly activity, ...)."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions.measures import finished, mean_parts, merge_parts
from farelens.functions.periods import period_start

UNKNOWN = "Inconnu"

DAILY_MEANS = (
    "avg_total_amount",
    "avg_tip_amount",
    "avg_trip_distance",
    "avg_trip_duration_seconds",
)

FEE_COMPONENTS = {
    "fare": "avg_fare_amount",
    "tip": "avg_tip_amount",
    "tolls": "avg_tolls_amount",
    "mta_tax": "avg_mta_tax",
    "improvement_surcharge": "avg_improvement_surcharge",
    "extra": "avg_extra",
}


def year_filter(report: DataFrame, years: Collection[int] | None = (2024,)) -> DataFrame:
    """Rows of a dated report that fall in the selected years, by date; no years keeps every row."""
    chosen = report.where(F.year("date").isin(*years)) if years else report
    return chosen.orderBy("date")


def period_rollup(daily: DataFrame, period: str, stable: bool = False, exact: bool = False) -> DataFrame:
    """Daily volume summed up to weeks, months, quarters or years.

    Means are weighted by ``trip_count``. Where a measure has NULLs that differs slightly from the mean over
    the trips themselves. ``exact=True`` gives the latter, as ``plans.reports.trip_volume(period=...)``
    does, from the mergeable states of a stored daily table (``plans.daily``).
    """
    if exact:
        states = daily.where("trip_count > 0").groupBy(period_start(F.col("date"), period).alias("date"))
        merged = states.agg(F.sum("trip_count").alias("trip_count"), *merge_parts(daily, DAILY_MEANS))
        return finished(merged, DAILY_MEANS).orderBy("date")
    start = period_start(F.col("date"), period)
    if period == "day":
        return daily.orderBy("date")
    products = daily.select(
        start.alias("date"),
        F.col("trip_count").alias("trips"),
        *[(F.col(mean) * F.col("trip_count")).alias(mean) for mean in DAILY_MEANS],
    )
    weighted = mean_parts(DAILY_MEANS, stable)
    totals = finished(
        products.groupBy("date").agg(F.sum("trips").alias("trip_count"), *weighted), DAILY_MEANS, sums=True
    )
    return totals.select(
        "date",
        "trip_count",
        *[(F.col(mean) / F.greatest("trip_count", F.lit(1))).alias(mean) for mean in DAILY_MEANS],
    ).orderBy("date")


def monthly_distribution(daily: DataFrame) -> DataFrame:
    """Mean trips per day for each month of the year, rounded half up; 0 for absent months."""
    profile = daily.groupBy(F.month("date").alias("month")).agg(
        F.floor(F.sum("trip_count") / F.count("*") + 0.5).alias("avg_trips")
    )
    months = daily.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return (
        months.join(profile, "month", "left")
        .select("month", F.coalesce("avg_trips", F.lit(0)).alias("avg_trips"))
        .orderBy("month")
    )


def hourly_heatmap(hourly: DataFrame, dense: bool = False) -> DataFrame:
    """Hourly activity as cells (x = hour, y = day with Monday 0, v = trips) with an intensity.

    Trips without a pickup time have no cell. ``dense=True`` adds the empty cells of the 7 x 24 grid.
    """
    cells = hourly.where(F.col("day_of_week").isNotNull()).select(
        F.col("hour_of_day").alias("x"),
        (F.col("day_of_week") - 1).alias("y"),
        F.col("trip_count").alias("v"),
    )
    if dense:
        grid = (
            hourly.sparkSession.range(7)
            .select(F.col("id").cast("int").alias("y"))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23))))
        )
        cells = grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("v", F.lit(0)).alias("v"))
    share = F.col("v") / F.max("v").over(Window.partitionBy())
    intensity = F.when(F.col("v") == 0, 0.0).otherwise(F.least(F.lit(0.1) + share * 0.9, F.lit(1.0)))
    return cells.withColumn("intensity", intensity).orderBy("y", "x")


def trend_series(
    rollup: DataFrame, metrics: Sequence[str] = ("trip_count", "avg_total_amount")
) -> DataFrame:
    """Chosen metrics of a roll-up in long form ``(date, metric, value)``."""
    unknown = set(metrics) - {"trip_count", *DAILY_MEANS}
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    values = rollup.select("date", *[F.col(m).cast("double").alias(m) for m in metrics])
    return values.unpivot("date", list(metrics), "metric", "value").orderBy("date", "metric")


def financial_series(breakdown: DataFrame, years: Collection[int] | None = (2024,)) -> DataFrame:
    """The six fee components of a financial breakdown as ``(date, component, amount)``."""
    wide = year_filter(breakdown, years).select(
        "date", *[F.col(mean).alias(component) for component, mean in FEE_COMPONENTS.items()]
    )
    return wide.unpivot("date", list(FEE_COMPONENTS), "component", "amount").orderBy("date", "component")


def passenger_labels(passengers: DataFrame) -> DataFrame:
    """Passenger analysis with the count as a text label, NULL shown as unknown."""
    label = F.coalesce(F.col("passenger_count").cast("string"), F.lit(UNKNOWN))
    return passengers.select(label.alias("passenger_label"), "trip_count")
