"""Load and store the star schema."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelens.functions.durations import interval_from_seconds
from farelens.sources.schema import FACT_TRIPS, MONTH_PARTITION, SCHEMAS, TripTables, conform


def write_tables(tables: TripTables, root: str) -> None:
    """Write the six tables as Parquet under ``root``; the fact table is partitioned by pickup month.

    The rebalance hint gives evenly sized files: adaptive execution splits a month that holds a
    large share of the rows and merges small ones.
    """
    months = tables.dim_date.select(
        F.col("date_key").alias("pickup_date_key"),
        F.col("year").alias("partition_year"),
        F.col("month").alias("partition_month"),
    ).dropDuplicates(["pickup_date_key"])
    fact = conform(tables.fact_trips, FACT_TRIPS).join(months, "pickup_date_key", "left")
    (
        fact.select(*FACT_TRIPS.names, *MONTH_PARTITION.names)
        .hint("rebalance", *MONTH_PARTITION.names)
        .write.partitionBy(*MONTH_PARTITION.names)
        .parquet(f"{root}/fact_trips")
    )
    for name, df in tables.items():
        if name != "fact_trips":
            conform(df, SCHEMAS[name]).hint("rebalance").write.parquet(f"{root}/{name}")


def write_trip_ids(tables: TripTables, root: str, buckets: int) -> None:
    """Store the trip ids alone, in ``buckets`` buckets of themselves.

    Rows of one id lie in one bucket, so counting ids (duplicates, uniqueness) needs no shuffle. Buckets should
    be so many that one is a task's work: about 20 million ids.
    """
    ids = tables.fact_trips.select("trip_id").repartition(buckets, "trip_id").write.bucketBy(buckets, "trip_id")
    ids.saveAsTable(_ids_name(root), format="parquet", path=f"{root}/trip_ids")


def load_trip_ids(spark: SparkSession, root: str, buckets: int) -> DataFrame:
    """The ids stored by :func:`write_trip_ids`. Buckets are known to Spark through its catalog, so the files are
    entered there, as an external table, if this session's catalog does not have them."""
    name = _ids_name(root)
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} (trip_id BIGINT) USING parquet CLUSTERED BY (trip_id) INTO {int(buckets)} BUCKETS"
            f" LOCATION '{root}/trip_ids'"
        )
    return spark.read.table(name)


def _ids_name(root: str) -> str:
    return f"farelens_trip_ids_{hashlib.md5(root.encode()).hexdigest()}"


def load_tables(spark: SparkSession, root: str) -> TripTables:
    """Read tables stored by :func:`write_tables`, without schema inference."""
    stored = dict(SCHEMAS)
    stored["fact_trips"] = T.StructType([*FACT_TRIPS.fields, *MONTH_PARTITION.fields])
    return TripTables(
        **{
            name: spark.read.schema(schema).parquet(f"{root}/{name}")
            for name, schema in stored.items()
        }
    )


def tables_from_jdbc(
    spark: SparkSession,
    url: str,
    *,
    trip_id_bounds: tuple[int, int],
    num_partitions: int,
    **options: str,
) -> TripTables:
    """Read the six tables from a PostgreSQL database that holds the same schema.

    The fact table is read in ``num_partitions`` ranges of ``trip_id`` between ``trip_id_bounds``
    (rows outside the bounds fall into the outer ranges). PostgreSQL intervals do not map to a
    Spark interval, so the duration travels as seconds and is turned back here.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("preferTimestampNTZ", "true")
    frames: dict[str, DataFrame] = {}
    for name, schema in SCHEMAS.items():
        if name == "fact_trips":
            plain = ", ".join(n for n in schema.names if n != "trip_duration")
            low, high = trip_id_bounds
            rows = (
                reader.option(
                    "dbtable",
                    f"(SELECT {plain}, EXTRACT(EPOCH FROM trip_duration)::float8 AS seconds"
                    " FROM fact_trips) AS trips",
                )
                .option("partitionColumn", "trip_id")
                .option("lowerBound", str(low))
                .option("upperBound", str(high))
                .option("numPartitions", str(num_partitions))
                .load()
            )
            rows = rows.withColumn("trip_duration", interval_from_seconds(F.col("seconds")))
        else:
            rows = spark.read.jdbc(url, name, properties=dict(options))
        frames[name] = conform(rows, schema)
    return TripTables(**frames)
