"""The trip reports.

Every grouped report aggregates the fact table on its own key columns before any join, so that
only one row per key and task is shuffled, whatever the skew, and dimensions are joined to the
small result. All take ``years`` (calendar years of pickup to keep, default all); those with
grouped means take ``stable`` (means that do not depend on task order, see
``farelens.functions.measures``).
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions.durations import elapsed_seconds
from farelens.functions.measures import finished, mean_parts, merge_parts
from farelens.functions.periods import period_start
from farelens.operators.distribution import distribution
from farelens.operators.enrich import in_role
from farelens.operators.reshape import UNKNOWN
from farelens.operators.scope import Years, trips_in
from farelens.sources.schema import TripTables


def trip_count() -> Column:
    # trip_id is the primary key and never NULL, so counting rows counts ids without reading them.
    return F.count("*").alias("trip_count")


def volume_measures() -> dict[str, Column]:
    return {
        "avg_total_amount": F.col("total_amount"),
        "avg_tip_amount": F.col("tip_amount"),
        "avg_trip_distance": F.col("trip_distance"),
        "avg_trip_duration_seconds": elapsed_seconds(F.col("trip_duration")),
    }


def fee_measures() -> dict[str, Column]:
    amounts = ["fare_amount", "tip_amount", "tolls_amount", "mta_tax", "improvement_surcharge", "extra", "total_amount"]
    return {f"avg_{c}": F.col(c) for c in amounts}


def per_key(fact: DataFrame, keys: list[str], measures: Mapping[str, Column], stable: bool) -> DataFrame:
    """Trip count and mean parts per distinct combination of fact keys."""
    named = fact.select(*keys, *[value.cast("double").alias(name) for name, value in measures.items()])
    return named.groupBy(*keys).agg(trip_count(), *mean_parts(measures, stable))


def regroup(joined: DataFrame, keys: list[Column], names: Collection[str]) -> DataFrame:
    """Merge per-key rows into the report's groups and finish the means."""
    merged = joined.groupBy(*keys).agg(F.sum("trip_count").alias("trip_count"), *merge_parts(joined, names))
    return finished(merged, names)


def trip_volume(
    tables: TripTables, *, period: str = "day", years: Years = None, stable: bool = False
) -> DataFrame:
    """Trips and mean total, tip, distance and duration per pickup day; days without trips are absent.

    A longer ``period`` gives the means over all its trips (compare ``reshape.period_rollup``).
    """
    measures = volume_measures()
    trips = per_key(trips_in(tables, years), ["pickup_date_key"], measures, stable)
    return _per_period(tables, trips, period, measures)


def financial_breakdown(
    tables: TripTables, *, period: str = "month", years: Years = None, stable: bool = False
) -> DataFrame:
    """Mean of each fee component and of the total per period."""
    measures = fee_measures()
    trips = per_key(trips_in(tables, years), ["pickup_date_key"], measures, stable)
    return _per_period(tables, trips, period, measures).drop("trip_count")


def _per_period(
    tables: TripTables, trips: DataFrame, period: str, measures: Mapping[str, Column]
) -> DataFrame:
    days = tables.dim_date.select(F.col("date_key").alias("pickup_date_key"), "full_date")
    start = period_start(F.col("full_date"), period).alias("date")
    return regroup(trips.join(days, "pickup_date_key"), [start], measures).orderBy("date")


def payment_analysis(tables: TripTables, *, years: Years = None, stable: bool = False) -> DataFrame:
    """Trips and mean tip per payment type."""
    measures = {"avg_tip_amount": F.col("tip_amount")}
    return _by_name(trips_in(tables, years), tables.dim_payment_type, "payment_type", measures, stable)


def rate_code_analysis(tables: TripTables, *, years: Years = None, stable: bool = False) -> DataFrame:
    """Trips and mean total, distance and tip per rate code."""
    measures = {
        "avg_total_amount": F.col("total_amount"),
        "avg_trip_distance": F.col("trip_distance"),
        "avg_tip_amount": F.col("tip_amount"),
    }
    return _by_name(trips_in(tables, years), tables.dim_rate_code, "rate_code", measures, stable)


def _by_name(
    fact: DataFrame, dimension: DataFrame, entity: str, measures: Mapping[str, Column], stable: bool
) -> DataFrame:
    # The label is put on after grouping: a dimension row that happens to be called 'Inconnu'
    # stays apart from the trips without a name.
    key, name = f"{entity}_key", f"{entity}_name"
    trips = per_key(fact, [key], measures, stable)
    named = trips.join(dimension.select(key, name), key, "left")
    report = regroup(named, [F.col(name)], measures)
    return report.withColumn(name, F.coalesce(name, F.lit(UNKNOWN))).orderBy(F.desc("trip_count"), name)


def vendor_analysis(tables: TripTables, *, years: Years = None, stable: bool = False) -> DataFrame:
    """Trips and mean total and distance per vendor (key and name)."""
    measures = {"avg_total_amount": F.col("total_amount"), "avg_trip_distance": F.col("trip_distance")}
    trips = per_key(trips_in(tables, years), ["vendor_key"], measures, stable)
    vendors = tables.dim_vendor.select(
        "vendor_key", F.col("vendor_key").alias("known_key"), "vendor_name"
    )
    report = regroup(
        trips.join(vendors, "vendor_key", "left"), [F.col("known_key"), F.col("vendor_name")], measures
    )
    label = F.coalesce(
        F.nullif(F.trim("vendor_name"), F.lit("")),
        F.concat(F.lit("Vendor "), F.col("known_key").cast("string")),
        F.lit(UNKNOWN),
    )
    return (
        report.withColumn("vendor_name", label)
        .orderBy(F.desc("trip_count"), "vendor_name", "known_key")
        .drop("known_key")
    )


def hourly_activity(tables: TripTables, *, years: Years = None) -> DataFrame:
    """Trips per ISO weekday (Monday 1) and hour of pickup; trips without a pickup time come last."""
    pickup = F.col("tpep_pickup_datetime")
    return (
        trips_in(tables, years)
        .groupBy(
            (F.weekday(pickup) + 1).alias("day_of_week"),
            F.hour(pickup).alias("hour_of_day"),
        )
        .agg(trip_count())
        .orderBy(F.asc_nulls_last("day_of_week"), F.asc_nulls_last("hour_of_day"))
    )


def passenger_analysis(tables: TripTables, *, years: Years = None) -> DataFrame:
    """Trips per passenger count, the unknown count last."""
    return (
        trips_in(tables, years)
        .groupBy("passenger_count")
        .agg(trip_count())
        .orderBy(F.asc_nulls_last("passenger_count"))
    )


def trip_duration_stats(tables: TripTables, *, years: Years = None, approx: bool = False) -> DataFrame:
    """Mean, extremes and quartiles of positive trip durations, in seconds; 0.0 without trips.

    Quartiles are exact; ``approx=True`` takes Spark's one-pass approximate percentiles instead.
    """
    timed = trips_in(tables, years).where(
        F.col("trip_duration") > F.expr("INTERVAL '0' SECOND")
    )
    if approx:
        stats = timed.select(elapsed_seconds(F.col("trip_duration")).alias("s")).agg(
            F.avg("s").alias("mean"),
            F.min("s").alias("lowest"),
            F.max("s").alias("highest"),
            F.percentile_approx("s", [0.25, 0.5, 0.75]).alias("quantiles"),
        )
    else:
        stats = distribution(timed.select(elapsed_seconds(F.col("trip_duration")).alias("value")))
    figures = {
        "avg": F.col("mean"),
        "min": F.col("lowest"),
        "max": F.col("highest"),
        "p25": F.col("quantiles")[0],
        "p50": F.col("quantiles")[1],
        "p75": F.col("quantiles")[2],
    }
    return stats.select(
        *[F.coalesce(v, F.lit(0.0)).alias(f"{k}_duration_seconds") for k, v in figures.items()]
    )


def fare_efficiency(tables: TripTables, *, years: Years = None) -> DataFrame:
    """Mean fare per distance unit and per minute, each a mean of per-trip ratios."""
    fare, distance = F.col("fare_amount"), F.col("trip_distance")
    seconds = elapsed_seconds(F.col("trip_duration"))
    ratios = {
        "avg_fare_per_km": F.when(distance > 0, fare / distance),
        "avg_fare_per_minute": F.when(seconds > 0, fare / (seconds / 60.0)),
    }
    return trips_in(tables, years).agg(
        *[F.coalesce(F.avg(ratio), F.lit(0.0)).alias(name) for name, ratio in ratios.items()]
    )


def zone_activity(tables: TripTables, *, years: Years = None, stable: bool = False) -> DataFrame:
    """Trips and mean total per pickup zone; trips from unknown places share one all-NULL row."""
    measures = {"avg_total_amount": F.col("total_amount")}
    trips = per_key(trips_in(tables, years), ["pickup_location_key"], measures, stable)
    places = tables.dim_location.select(
        F.col("location_key").alias("pickup_location_key"), "location_id", "zone", "borough"
    )
    return regroup(
        trips.join(places, "pickup_location_key", "left"),
        [F.col("location_id"), F.col("zone"), F.col("borough")],
        measures,
    ).orderBy(F.desc("trip_count"), "location_id", "zone", "borough")


def borough_flows(
    tables: TripTables, *, top_n: int | None = 100, years: Years = None, stable: bool = False
) -> DataFrame:
    """The busiest borough-to-borough flows with their mean fare; ``top_n=None`` gives all of them.

    Trips from or to a place without a named borough are left out. Equal counts are ordered by name.
    """
    measures = {"avg_fare_amount": F.col("fare_amount")}
    ends = ["pickup_location_key", "dropoff_location_key"]
    trips = per_key(trips_in(tables, years), ends, measures, stable)
    named = tables.dim_location.where(~F.col("borough").isin("Unknown", ""))
    for role in ("pickup", "dropoff"):
        places = in_role(named.select("location_key", "borough"), "location_key", role)
        trips = trips.join(places, f"{role}_location_key")
    boroughs = ["pickup_borough", "dropoff_borough"]
    flows = regroup(trips, [F.col(b) for b in boroughs], measures)
    flows = flows.orderBy(F.desc("trip_count"), *boroughs)
    return flows if top_n is None else flows.limit(top_n)
