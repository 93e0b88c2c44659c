"""A local session and a builder for small hand-made star schemas."""

from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from farelens import TripTables  # noqa: E402
from farelens.operators.calendar import calendar  # noqa: E402
from farelens.sources.schema import SCHEMAS  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("farelens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    from farelens.sources.driver_star import stage_star

    return stage_star(spark, TESTDATA)


@pytest.fixture
def make_tables(spark):
    """``make_tables(trips, **dimension_rows)``: rows are dicts, absent columns are NULL.

    A trip's ``pickup`` and ``dropoff`` datetimes also set the date keys and the duration, unless
    these are given. The calendar runs from ``days[0]`` to ``days[1]``.
    """

    def frame(name, rows):
        schema = SCHEMAS[name]
        return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)

    def key(moment):
        return None if moment is None else int(moment.strftime("%Y%m%d"))

    def build(
        trips=(),
        days=(dt.date(2024, 1, 1), dt.date(2024, 12, 31)),
        dim_location=(),
        dim_payment_type=(),
        dim_rate_code=(),
        dim_vendor=(),
    ):
        facts = []
        for i, trip in enumerate(trips):
            pickup, dropoff = trip.get("pickup"), trip.get("dropoff")
            row = {
                "trip_id": i,
                "tpep_pickup_datetime": pickup,
                "tpep_dropoff_datetime": dropoff,
                "pickup_date_key": key(pickup),
                "dropoff_date_key": key(dropoff),
            }
            if pickup and dropoff:
                row["trip_duration"] = dropoff - pickup
            row.update({k: v for k, v in trip.items() if k not in ("pickup", "dropoff")})
            facts.append(row)
        return TripTables(
            fact_trips=frame("fact_trips", facts),
            dim_date=calendar(spark, *days) if days else frame("dim_date", []),
            dim_location=frame("dim_location", dim_location),
            dim_payment_type=frame("dim_payment_type", dim_payment_type),
            dim_rate_code=frame("dim_rate_code", dim_rate_code),
            dim_vendor=frame("dim_vendor", dim_vendor),
        )

    return build


def rows(df):
    """The rows of a frame as plain tuples, in its own order."""
    return [tuple(r) for r in df.collect()]
