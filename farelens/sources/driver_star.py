"""The star schema derived from the TPC-H-like test tables, by the rules in FIXTURES.md."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.functions.durations import between_timestamps
from farelens.operators.calendar import calendar, date_key
from farelens.sources.schema import (
    DIM_LOCATION,
    DIM_PAYMENT_TYPE,
    DIM_RATE_CODE,
    DIM_VENDOR,
    FACT_TRIPS,
    TripTables,
    conform,
)
from farelens.sources.tables import load_tables, load_trip_ids, write_tables, write_trip_ids

SOURCES = ("lineitem", "orders", "customer", "supplier", "nation", "region")
RAW_PICKUPS = "trip_id bigint, pickup_datetime string"
FIRST_DAY, LAST_DAY = dt.date(1995, 1, 1), dt.date(2001, 12, 31)

# The two code dimensions.
PAYMENT_TYPES = "(1, 'Credit card'), (2, 'Cash'), (3, 'No charge'), (4, NULL)"
RATE_CODES = "(1, 'Standard'), (2, 'JFK'), (3, 'Newark'), (4, 'Nassau'), (5, 'Negotiated'), (6, 'Group')"


def derive_star(spark: SparkSession, sf_dir: str) -> TripTables:
    """The six tables as lazy plans over the Parquet files in ``sf_dir``. A report on them reads, joins and shuffles
    only the columns it needs, which is far less than storing all trips."""
    src = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCES}
    return TripTables(
        fact_trips=_fact_trips(src),
        dim_date=calendar(spark, FIRST_DAY, LAST_DAY),
        dim_location=_dim_location(src),
        dim_payment_type=_codes(spark, "payment_type", PAYMENT_TYPES, DIM_PAYMENT_TYPE),
        dim_rate_code=_codes(spark, "rate_code", RATE_CODES, DIM_RATE_CODE),
        dim_vendor=_dim_vendor(src),
    )


def stage_star(spark: SparkSession, sf_dir: str) -> TripTables:
    """The six tables, written once per application to the shared checkpoint folder and read back."""
    return _stage(spark, sf_dir)[0]


def input_version(spark: SparkSession, sf_dir: str) -> tuple:
    """What the application, the source files and their state are known by."""
    return (spark.sparkContext.applicationId, sf_dir, _fingerprint(spark, sf_dir))


def new_folder(spark: SparkSession) -> str:
    """A folder of this application's own in the folder all executors share."""
    return f"{_shared_folder(spark)}/farelens-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def stage_raw_pickups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`raw_pickups`, stored beside the staged tables at its first use."""
    tables, root = _stage(spark, sf_dir)
    path = f"{root}/raw_pickups"
    if path not in _staged_raw:
        raw_pickups(tables).write.parquet(path)
        _staged_raw[path] = spark.read.schema(RAW_PICKUPS).parquet(path)
    return _staged_raw[path]


_staged: dict[tuple, tuple[TripTables, str]] = {}
_staged_raw: dict[str, DataFrame] = {}


def _stage(spark: SparkSession, sf_dir: str) -> tuple[TripTables, str]:
    version = input_version(spark, sf_dir)
    if version not in _staged:
        root = new_folder(spark)
        write_tables(derive_star(spark, sf_dir), root)
        tables = load_tables(spark, root)
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        write_trip_ids(tables, root, buckets)
        _staged[version] = replace(tables, trip_ids=load_trip_ids(spark, root, buckets)), root
    return _staged[version]


def _shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a folder in the warehouse, on one machine only: on a cluster the
    warehouse may be a folder of the driver's own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_farelens"


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of the source files, so that changed inputs are not answered from old tables."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    marks = []
    for name in SOURCES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(hadoop)
        marks.append((fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(marks)


def raw_pickups(tables: TripTables) -> DataFrame:
    """``(trip_id, pickup_datetime)`` as raw text, some of it not in the expected format."""
    pickup = F.col("tpep_pickup_datetime")
    text = (
        F.when(F.col("trip_id") % 29 == 0, F.lit(None))
        .when(F.col("trip_id") % 23 == 0, F.lit("n/a"))
        .when(F.col("trip_id") % 19 == 0, F.date_format(pickup, "dd/MM/yyyy HH:mm"))
        .otherwise(pickup.cast("string"))
    )
    return tables.fact_trips.select("trip_id", text.alias("pickup_datetime"))


def _fact_trips(src: dict[str, DataFrame]) -> DataFrame:
    # Line items become few whole numbers before they meet their orders, so that a report moves only what it needs.
    # That join is the same at every size: both sides are shuffled, once.
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    returned = F.col("l_returnflag")

    def missing_every(divisor: int, value):
        return F.when(part % divisor != 0, value)

    pickup_second = (part * 7919 + supp * 613 + line * 3571) % 86400
    ride_second = ((part * 31 + supp * 17 + F.col("l_quantity").cast("bigint") * 60) % 5400 - 60).cast("int")
    fare = F.floor(F.col("l_extendedprice") / 10)
    tip = F.floor(fare * F.round(F.col("l_discount") * 100) / 100)
    extra = F.round(F.col("l_tax") * 1000).cast("bigint")
    tip_or_nothing = F.when(returned == "R", 0).otherwise(tip)
    tolls = F.when(F.col("l_linestatus") == "O", 655).otherwise(0)
    lines = src["lineitem"].select(
        "l_orderkey",
        "l_suppkey",
        line.alias("line"),
        pickup_second.cast("int").alias("pickup_second"),
        ride_second.alias("ride_second"),
        missing_every(23, ride_second).alias("timed_second"),
        missing_every(17, supp).alias("vendor_key"),
        (part % 29 != 0).alias("placed"),
        (returned == "A").alias("forwarded"),
        missing_every(13, line - 1).alias("passenger_count"),
        F.col("l_quantity").alias("quantity"),
        fare.alias("fare"),
        extra.alias("extra"),
        F.when(returned != "R", tip).alias("tip"),
        tolls.alias("tolls"),
        missing_every(31, fare + extra + 150 + tip_or_nothing + tolls).alias("total"),
    )
    # Customers and suppliers are broadcast only when Spark finds them small.
    placed = src["orders"].join(src["customer"], F.col("o_custkey") == F.col("c_custkey"))
    base = (
        lines.hint("merge")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(src["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    )
    timed = base.withColumn(
        "pk", F.timestamp_add("second", F.col("pickup_second"), F.col("o_orderdate"))
    ).withColumn("dk", F.timestamp_add("second", F.col("ride_second"), F.col("pk")))

    pk, dk = F.col("pk"), F.col("dk")
    trips = timed.select(
        (F.col("l_orderkey") * 10 + F.col("line")).alias("trip_id"),
        "vendor_key",
        date_key(pk).alias("pickup_date_key"),
        date_key(dk).alias("dropoff_date_key"),
        F.when(F.col("placed"), F.col("c_nationkey")).alias("pickup_location_key"),
        F.col("s_nationkey").alias("dropoff_location_key"),
        F.col("line").alias("rate_code_key"),
        F.substring("o_orderpriority", 1, 1).alias("payment_type_key"),
        F.when(F.col("forwarded"), "Y").otherwise("N").alias("store_and_fwd_flag"),
        pk.alias("tpep_pickup_datetime"),
        dk.alias("tpep_dropoff_datetime"),
        "passenger_count",
        ((F.col("quantity") - 1) / 2.0).alias("trip_distance"),
        (F.col("fare") / 100.0).alias("fare_amount"),
        (F.col("extra") / 100.0).alias("extra"),
        F.lit(0.5).alias("mta_tax"),
        (F.col("tip") / 100.0).alias("tip_amount"),
        (F.col("tolls") / 100.0).alias("tolls_amount"),
        F.lit(1.0).alias("improvement_surcharge"),
        (F.col("total") / 100.0).alias("total_amount"),
        F.lit(2.5).alias("congestion_surcharge"),
        F.lit(0.0).alias("airport_fee"),
        between_timestamps(pk, F.timestamp_add("second", F.col("timed_second"), pk)).alias("trip_duration"),
    )
    return conform(trips, FACT_TRIPS)


def _dim_location(src: dict[str, DataFrame]) -> DataFrame:
    key = F.col("n_nationkey")
    borough = (
        F.when(key == 24, F.lit(None))
        .when(key == 23, "Unknown")
        .when(key == 22, "")
        .otherwise(F.col("r_name"))
    )
    zones = src["nation"].join(src["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return conform(
        zones.select(
            key.alias("location_key"),
            key.alias("location_id"),
            borough.alias("borough"),
            F.col("n_name").alias("zone"),
            F.lit(None).alias("service_zone"),
        ),
        DIM_LOCATION,
    )


def _dim_vendor(src: dict[str, DataFrame]) -> DataFrame:
    key = F.col("s_suppkey")
    name = (
        F.when(key % 10 == 0, "   ")
        .when(key % 10 == 1, F.lit(None))
        .otherwise(F.concat(F.lit(" "), F.col("s_name")))
    )
    vendors = src["supplier"].select(
        key.alias("vendor_key"), key.alias("vendor_id"), name.alias("vendor_name")
    )
    return conform(vendors, DIM_VENDOR)


def _codes(spark: SparkSession, entity: str, values: str, schema) -> DataFrame:
    rows = spark.sql(
        f"SELECT code AS {entity}_key, code AS {entity}_id, label AS {entity}_name"
        f" FROM VALUES {values} AS codes(code, label)"
    )
    return conform(rows, schema)
