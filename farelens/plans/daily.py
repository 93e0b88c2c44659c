"""A stored table of one row per pickup day, from which roll-ups are made without reading trips again.

Each row holds mergeable states: the number of trips, and for every measure of the volume and fee reports the
parts of its exact mean (``farelens.functions.measures``), plus a quantile sketch of positive durations.
Any years and any longer period follow from it by adding up, and equal what the trips themselves give. The table
is partitioned by month, and a refresh computes and replaces the given months only.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.functions.durations import elapsed_seconds
from farelens.functions.measures import finished, mean_parts, merge_parts
from farelens.functions.periods import period_start
from farelens.operators.distribution import QUARTILES
from farelens.operators.reshape import period_rollup
from farelens.plans.reports import fee_measures, trip_count, volume_measures
from farelens.sources.schema import MONTH_PARTITION, TripTables

Months = Collection[tuple[int, int]] | None
SKETCH = "duration_sketch"
SKETCH_SIZE = 400  # the k of the sketch: ranks are off by about 0.4 % at most


def _in_months(df: DataFrame, year: str, month: str, months: Months) -> DataFrame:
    if months is None:
        return df
    chosen = F.lit(False)
    for y, m in sorted(set(months)):
        chosen = chosen | ((F.col(year) == y) & (F.col(month) == m))
    return df.where(chosen)


def daily_states(tables: TripTables, months: Months = None) -> DataFrame:
    """One row per calendar day of ``months`` (year, month; default all), days without trips included.

    ``(date, year, month, trip_count, parts..., duration_sketch)``. Stored trips are pruned to the months.
    """
    fact = tables.fact_trips
    days = _in_months(tables.dim_date, "year", "month", months).select(
        F.col("date_key").alias("pickup_date_key"), F.col("full_date").alias("date"), "year", "month"
    )
    if set(MONTH_PARTITION.names) <= set(fact.columns):
        fact = _in_months(fact, *MONTH_PARTITION.names, months)
    elif months is not None:
        fact = fact.join(days.select("pickup_date_key"), "pickup_date_key", "left_semi")
    measures = {**volume_measures(), **fee_measures()}
    seconds = elapsed_seconds(F.col("trip_duration"))
    named = fact.select(
        "pickup_date_key",
        *[value.cast("double").alias(name) for name, value in measures.items()],
        F.when(seconds > 0, seconds).alias("positive_seconds"),
    )
    states = named.groupBy("pickup_date_key").agg(
        trip_count(), *mean_parts(measures, stable=True), F.kll_sketch_agg_double("positive_seconds", SKETCH_SIZE).alias(SKETCH)
    )
    return (
        days.join(states, "pickup_date_key", "left")
        .drop("pickup_date_key")
        .withColumn("trip_count", F.coalesce("trip_count", F.lit(0)))
    )


def write_daily(tables: TripTables, path: str) -> None:
    """Store :func:`daily_states` of all days under ``path``, a file per month, from one scan of the trips."""
    _write(daily_states(tables), path, "errorifexists")


def refresh_daily(tables: TripTables, path: str, months: Collection[tuple[int, int]]) -> None:
    """Compute the given months again and replace their partitions; no other is touched.

    Days without trips have rows too, so a month that lost all its trips is replaced as well.
    """
    _write(daily_states(tables, months), path, "overwrite")


def _write(states: DataFrame, path: str, mode: str) -> None:
    by_month = states.repartition("year", "month").sortWithinPartitions("date").write.partitionBy("year", "month")
    by_month.option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def load_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def volume(daily: DataFrame, period: str = "day") -> DataFrame:
    """What ``reports.trip_volume(period=..., stable=True)`` gives, from the stored table."""
    return period_rollup(daily, period, exact=True)


def breakdown(daily: DataFrame, period: str = "month") -> DataFrame:
    """What ``reports.financial_breakdown(period=..., stable=True)`` gives, from the stored table."""
    names = list(fee_measures())
    periods = daily.where("trip_count > 0").groupBy(period_start(F.col("date"), period).alias("date"))
    return finished(periods.agg(*merge_parts(daily, names)), names).orderBy("date")


def duration_quantiles(daily: DataFrame, fractions: Collection[float] = QUARTILES) -> DataFrame:
    """``(fraction, seconds)``: approximate quantiles of positive durations, from the merged sketches of the days.

    NULL without any positive duration. Years are chosen by filtering ``daily``, which reads their partitions only.
    """
    whole = daily.where(F.col(SKETCH).isNotNull()).agg(F.kll_merge_agg_double(SKETCH).alias("s"))
    some = F.kll_sketch_get_n_double("s") > 0
    at: list[Column] = [
        F.struct(
            F.lit(float(p)).alias("fraction"),
            F.when(some, F.kll_sketch_get_quantile_double("s", F.lit(float(p)))).alias("seconds"),
        )
        for p in fractions
    ]
    return whole.select(F.explode(F.array(*at)).alias("q")).select("q.*")
