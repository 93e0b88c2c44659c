"""The star schema: one trip fact table and five dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FACT_TRIPS = T.StructType(
    [
        T.StructField("trip_id", T.LongType(), False),
        T.StructField("vendor_key", T.IntegerType()),
        T.StructField("pickup_date_key", T.IntegerType()),
        T.StructField("dropoff_date_key", T.IntegerType()),
        T.StructField("pickup_location_key", T.IntegerType()),
        T.StructField("dropoff_location_key", T.IntegerType()),
        T.StructField("rate_code_key", T.IntegerType()),
        T.StructField("payment_type_key", T.IntegerType()),
        T.StructField("store_and_fwd_flag", T.StringType()),
        T.StructField("tpep_pickup_datetime", T.TimestampNTZType()),
        T.StructField("tpep_dropoff_datetime", T.TimestampNTZType()),
        T.StructField("passenger_count", T.IntegerType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("congestion_surcharge", T.DoubleType()),
        T.StructField("airport_fee", T.DoubleType()),
        T.StructField("trip_duration", T.DayTimeIntervalType()),
    ]
)

DIM_DATE = T.StructType(
    [
        T.StructField("date_key", T.IntegerType(), False),
        T.StructField("full_date", T.DateType(), False),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("month", T.IntegerType(), False),
        T.StructField("day", T.IntegerType(), False),
        T.StructField("day_of_week", T.IntegerType(), False),
        T.StructField("day_name", T.StringType(), False),
        T.StructField("month_name", T.StringType(), False),
        T.StructField("quarter", T.IntegerType(), False),
        T.StructField("is_weekend", T.BooleanType(), False),
    ]
)

DIM_LOCATION = T.StructType(
    [
        T.StructField("location_key", T.IntegerType(), False),
        T.StructField("location_id", T.IntegerType()),
        T.StructField("borough", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)

DIM_PAYMENT_TYPE = T.StructType(
    [
        T.StructField("payment_type_key", T.IntegerType(), False),
        T.StructField("payment_type_id", T.IntegerType()),
        T.StructField("payment_type_name", T.StringType()),
    ]
)

DIM_RATE_CODE = T.StructType(
    [
        T.StructField("rate_code_key", T.IntegerType(), False),
        T.StructField("rate_code_id", T.IntegerType()),
        T.StructField("rate_code_name", T.StringType()),
    ]
)

DIM_VENDOR = T.StructType(
    [
        T.StructField("vendor_key", T.IntegerType(), False),
        T.StructField("vendor_id", T.IntegerType()),
        T.StructField("vendor_name", T.StringType()),
    ]
)

SCHEMAS = {
    "fact_trips": FACT_TRIPS,
    "dim_date": DIM_DATE,
    "dim_location": DIM_LOCATION,
    "dim_payment_type": DIM_PAYMENT_TYPE,
    "dim_rate_code": DIM_RATE_CODE,
    "dim_vendor": DIM_VENDOR,
}

# Partition columns of a fact table stored by farelens.sources.tables.write_tables: the calendar
# year and month of pickup_date_key. A fact table without them works too, only with less pruning.
MONTH_PARTITION = T.StructType(
    [
        T.StructField("partition_year", T.IntegerType()),
        T.StructField("partition_month", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class TripTables:
    """The six tables every report reads; any DataFrames with these columns will do.

    ``trip_ids``, if there, has the column ``trip_id`` of ``fact_trips`` row for row and is stored in buckets
    of it (``farelens.sources.tables``); checks of ids then need no shuffle.
    """

    fact_trips: DataFrame
    dim_date: DataFrame
    dim_location: DataFrame
    dim_payment_type: DataFrame
    dim_rate_code: DataFrame
    dim_vendor: DataFrame
    trip_ids: DataFrame | None = None

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in SCHEMAS]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order and cast each to its declared type."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
