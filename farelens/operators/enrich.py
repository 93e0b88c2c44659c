"""Trip durations and the fact table joined to its dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions.durations import between_timestamps
from farelens.sources.schema import FACT_TRIPS, TripTables


def with_trip_duration(fact: DataFrame) -> DataFrame:
    """Set ``trip_duration`` to dropoff minus pickup, replacing any stored value."""
    return fact.withColumn(
        "trip_duration",
        between_timestamps(F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime")),
    )


def in_role(dimension: DataFrame, key: str, role: str) -> DataFrame:
    """A copy of a dimension for one role, every column named ``<role>_<column>``.

    The key column becomes the fact's foreign key ``<role>_<key>``.
    """
    return dimension.select(
        *[F.col(c).alias(f"{role}_{c}") for c in [key, *(c for c in dimension.columns if c != key)]]
    )


def trips_enriched(tables: TripTables) -> DataFrame:
    """Every trip with the attributes of its five dimensions, date and location in both roles.

    Left joins without broadcast hints: Spark broadcasts a dimension whose size is under the
    session's limit and shuffles otherwise, where adaptive execution splits skewed keys.
    """
    return (
        tables.fact_trips.select(*FACT_TRIPS.names)
        .join(in_role(tables.dim_date, "date_key", "pickup"), "pickup_date_key", "left")
        .join(in_role(tables.dim_date, "date_key", "dropoff"), "dropoff_date_key", "left")
        .join(in_role(tables.dim_location, "location_key", "pickup"), "pickup_location_key", "left")
        .join(in_role(tables.dim_location, "location_key", "dropoff"), "dropoff_location_key", "left")
        .join(tables.dim_payment_type, "payment_type_key", "left")
        .join(tables.dim_rate_code, "rate_code_key", "left")
        .join(tables.dim_vendor, "vendor_key", "left")
    )
