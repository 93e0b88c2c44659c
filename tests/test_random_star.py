"""All registered reports against DuckDB on random trips full of NULLs, loose keys and ties."""

from __future__ import annotations

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import oracle_queries
from farelens.functions.measures import finished, mean_parts, merge_parts
from farelens.plans.daily import daily_states
from farelens.sources.driver_star import raw_pickups
from farelens.sources.schema import SCHEMAS, TripTables


def random_trips(seed, n=700):
    rng = random.Random(seed)

    def maybe(value, share=0.9):
        return value if rng.random() < share else None

    def cents(low, high):
        return rng.randint(low, high) / 100

    start = dt.datetime(1995, 1, 1)
    for _ in range(n):
        # A third of the trips share one moment, vendor and place.
        hot = rng.random() < 1 / 3
        pickup = dt.datetime(2001, 6, 15, 8) if hot else start + dt.timedelta(seconds=rng.randrange(220_000_000))
        yield {
            "trip_id": rng.randrange(n),
            "pickup": maybe(pickup),
            "dropoff": maybe(pickup + dt.timedelta(seconds=rng.randrange(-60, 4000))),
            "vendor_key": 3 if hot else maybe(rng.randrange(8)),
            "pickup_location_key": 1 if hot else maybe(rng.randrange(9)),
            "dropoff_location_key": maybe(rng.randrange(9)),
            "rate_code_key": maybe(rng.randrange(1, 5)),
            "payment_type_key": maybe(rng.randrange(1, 6)),
            "passenger_count": maybe(rng.randrange(5)),
            "trip_distance": maybe(rng.choice([0.0, 0.5, 1.25, 7.0, -1.0])),
            "fare_amount": maybe(cents(-500, 6000) if rng.random() < 0.97 else cents(20_000, 90_000)),
            "extra": maybe(cents(0, 100)),
            "mta_tax": 0.5,
            "tip_amount": maybe(cents(0, 900), 0.4),
            "tolls_amount": maybe(rng.choice([0.0, 6.55])),
            "improvement_surcharge": None,
            "total_amount": maybe(cents(300, 9000), 0.7),
        }


DIMENSIONS = {
    "dim_location": [
        {"location_key": k, "location_id": i, "borough": b, "zone": z}
        for k, i, b, z in [
            (0, 10, "Bronx", "A"),
            (1, 11, "Queens", "B"),
            (2, 12, "Queens", "C"),
            (3, 13, "Unknown", "D"),
            (4, 14, "", "E"),
            (5, None, None, None),
            (6, 16, "Asia Market", "F"),
        ]
    ],
    "dim_payment_type": [
        {"payment_type_key": k, "payment_type_name": n}
        for k, n in [(1, "Cash"), (2, "Inconnu"), (3, None), (4, "Cash")]
    ],
    "dim_rate_code": [{"rate_code_key": k, "rate_code_name": n} for k, n in [(1, "JFK"), (2, None)]],
    "dim_vendor": [
        {"vendor_key": k, "vendor_name": n}
        for k, n in [(0, "  "), (1, None), (2, " Acme"), (3, "Acme "), (4, ""), (5, "Vendor 4")]
    ],
}


@pytest.fixture(scope="module", params=[1, 2])
def both(request, spark, tmp_path_factory):
    """The same random star as Spark tables and as DuckDB tables."""
    folder = tmp_path_factory.mktemp("random")
    frames = _frames(spark, request.param)
    con = duckdb.connect()
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}")
        columns = "* REPLACE (to_microseconds(trip_duration) AS trip_duration)" if name == "fact_trips" else "*"
        con.execute(f"CREATE TABLE {name} AS SELECT {columns} FROM '{folder}/{name}/*.parquet'")
    stored = {name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}") for name in frames}
    return TripTables(**stored), con


def _frames(spark, seed):
    from farelens.operators.calendar import calendar

    facts = []
    for trip in random_trips(seed):
        pickup, dropoff = trip.pop("pickup"), trip.pop("dropoff")
        row = dict(trip, tpep_pickup_datetime=pickup, tpep_dropoff_datetime=dropoff)
        row["pickup_date_key"] = pickup and int(pickup.strftime("%Y%m%d"))
        row["dropoff_date_key"] = dropoff and int(dropoff.strftime("%Y%m%d"))
        row["trip_duration"] = dropoff - pickup if pickup and dropoff else None
        facts.append(row)

    def frame(name, data):
        schema = SCHEMAS[name]
        return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in data], schema)

    return {
        "fact_trips": frame("fact_trips", facts),
        # The calendar ends before some of the trips.
        "dim_date": calendar(spark, dt.date(1995, 1, 1), dt.date(2001, 9, 30)),
        **{name: frame(name, data) for name, data in DIMENSIONS.items()},
    }


# These ask for trips by pickup year; some random trips have a pickup time but no calendar day.
BY_CALENDAR_YEAR = {"payment_analysis_years"}


NAMES = [*registry.REPORTS, *registry.RAW_REPORTS, *registry.DAILY_REPORTS]


def normal(values):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in values)


@pytest.mark.parametrize("name", sorted(set(NAMES) - BY_CALENDAR_YEAR))
def test_matches_duckdb(both, name):
    tables, con = both
    if name in registry.RAW_REPORTS:
        report = registry.RAW_REPORTS[name](tables, raw_pickups(tables))
    elif name in registry.DAILY_REPORTS:
        report = registry.DAILY_REPORTS[name](daily_states(tables))
    else:
        report = registry.REPORTS[name](tables)
    expected = con.sql(oracle_queries.QUERIES[name])
    columns = sorted(report.columns)
    at = [expected.columns.index(c) for c in columns]
    got = sorted((normal(r[c] for c in columns) for r in report.collect()), key=repr)
    want = sorted((normal(r[i] for i in at) for r in expected.fetchall()), key=repr)
    assert got == want


rng_ = random.Random(3)


@pytest.mark.parametrize(
    "values",
    [
        [0.1] * 1000 + [-0.1] * 999 + [1e9 + 0.000001, -2.5, None],
        [1e-7] * 1000,
        [rng_.randint(-5000, 9000) / 100 for _ in range(999)],
        [rng_.uniform(-1, 1) * 10 ** rng_.randint(-9, 11) for _ in range(500)],
        [1e19, 1.0, -1e19, 3.5],
        [1e12 + 0.3, -1e12, 0.1] * 50,
        [1 / 3] * 3,
        [-0.0, 0.0],
        [None],
    ],
)
def test_exact_sum(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    got = finished(df.agg(*mean_parts(["v"], True)), ["v"], sums=True).first()[0]
    wanted = math.fsum(v for v in values if v is not None) if values != [None] else None
    assert got == wanted


@pytest.mark.parametrize(
    "values, wanted",
    [
        ([1.0, math.nan], math.nan),
        ([1.0, math.inf, 2.5], math.inf),
        ([math.inf, -math.inf], math.nan),
        ([1e300, 1.0, -1e300], 1.0),
        ([1e300], 1e300),
    ],
)
def test_exact_sum_of_what_is_not_cut_into_pieces(spark, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = finished(df.agg(*mean_parts(["v"], True)), ["v"], sums=True).first()[0]
    assert got == wanted or math.isnan(got) and math.isnan(wanted)


@pytest.mark.parametrize("stable", [False, True])
def test_parts_of_groups_merge_to_the_parts_of_all(spark, stable):
    rng = random.Random(9)
    values = [None if rng.random() < 0.1 else rng.uniform(-1, 1) * 10 ** rng.randint(-8, 11) for _ in range(600)]
    df = spark.createDataFrame([(i % 7, i % 2, v) for i, v in enumerate(values)], "a int, b int, m double")
    parts = df.groupBy("a", "b").agg(*mean_parts(["m"], stable)).repartition(3)
    merged = parts.groupBy("b").agg(*merge_parts(parts))
    for b, got in finished(merged, ["m"]).collect():
        present = [v for i, v in enumerate(values) if i % 2 == b and v is not None]
        wanted = math.fsum(present) / len(present)
        assert got == wanted if stable else got == pytest.approx(wanted)
