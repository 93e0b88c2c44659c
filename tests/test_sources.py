"""Storing, loading, enriching and exporting."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from farelens.functions.durations import elapsed_seconds, interval_from_seconds
from farelens.operators.enrich import trips_enriched, with_trip_duration
from farelens.plans import kpi, reports
from farelens.sources.driver_star import derive_star, stage_raw_pickups, stage_star
from farelens.sources.export import export
from farelens.sources.schema import SCHEMAS, conform
from farelens.sources.tables import load_tables, write_tables
from tests.conftest import TESTDATA, rows

NOON = dt.datetime(2024, 5, 10, 12)


def test_tables_survive_storage(spark, make_tables, tmp_path):
    trips = [
        {"pickup": NOON, "dropoff": NOON + dt.timedelta(days=1, microseconds=5), "fare_amount": 1.25},
        {"pickup": NOON, "dropoff": NOON - dt.timedelta(seconds=3)},
        {"passenger_count": 2},
        {"pickup": dt.datetime(1990, 1, 1)},
    ]
    t = make_tables(trips, dim_vendor=[{"vendor_key": 1, "vendor_name": "Acme"}])
    write_tables(t, str(tmp_path / "star"))
    back = load_tables(spark, str(tmp_path / "star"))
    for name, df in t.items():
        stored = getattr(back, name).select(*SCHEMAS[name].names)
        assert [f.dataType for f in stored.schema] == [f.dataType for f in SCHEMAS[name]]
        assert sorted(rows(stored), key=repr) == sorted(rows(df), key=repr)
    months = back.fact_trips.select("partition_year", "partition_month").distinct()
    assert set(rows(months)) == {(2024, 5), (None, None)}


def test_staging_is_done_once(spark):
    assert stage_star(spark, TESTDATA) is stage_star(spark, TESTDATA)


def test_raw_pickups_are_stored_once(spark, star):
    raw = stage_raw_pickups(spark, TESTDATA)
    assert raw is stage_raw_pickups(spark, TESTDATA)
    assert raw.count() == star.fact_trips.count()


@pytest.mark.parametrize(
    "report",
    [
        lambda t: reports.passenger_analysis(t, years=[1996, 1999]),
        lambda t: reports.trip_volume(t, years=[1996], stable=True),
        lambda t: kpi.kpi_busiest_month(t, year=2001, from_month=6, stable=True),
        lambda t: kpi.kpi_period_trend(t, period="quarter", years=[1998], stable=True),
    ],
)
def test_month_partitions_do_not_change_results(spark, star, report):
    assert rows(report(star)) == rows(report(derive_star(spark, TESTDATA)))


def test_conform_casts_and_orders(spark):
    loose = spark.createDataFrame([("7", "Acme", 3)], "vendor_id string, vendor_name string, vendor_key long")
    assert rows(conform(loose, SCHEMAS["dim_vendor"])) == [(3, 7, "Acme")]


def test_durations(spark, make_tables):
    t = make_tables([{"pickup": NOON, "dropoff": NOON + dt.timedelta(hours=30, milliseconds=250), "trip_duration": None}])
    seconds = elapsed_seconds(F.col("trip_duration"))
    timed = with_trip_duration(t.fact_trips).select("trip_duration", seconds.alias("s"))
    assert rows(timed) == [(dt.timedelta(hours=30, milliseconds=250), 108000.25)]
    for value in (-61.5, 0.0, 86400.000001):
        back = elapsed_seconds(interval_from_seconds(F.lit(value)))
        assert spark.range(1).select(back).first()[0] == value


def test_enriched_keeps_every_trip_and_both_roles(make_tables):
    t = make_tables(
        [
            {
                "pickup": dt.datetime(2024, 5, 10, 23),
                "dropoff": dt.datetime(2024, 5, 11, 1),
                "pickup_location_key": 1,
                "dropoff_location_key": 2,
                "vendor_key": 1,
                "rate_code_key": 5,
            },
            {},
        ],
        dim_location=[{"location_key": 1, "borough": "Bronx"}, {"location_key": 2, "borough": "Queens"}],
        dim_vendor=[{"vendor_key": 1, "vendor_name": "Acme"}],
    )
    wanted = ["trip_id", "pickup_day_name", "dropoff_day_name", "pickup_borough", "dropoff_borough", "vendor_name"]
    enriched = trips_enriched(t)
    assert len(enriched.columns) == len(set(enriched.columns)) == 23 + 2 * 9 + 2 * 4 + 3 * 2
    got = enriched.select(*wanted, "rate_code_name").orderBy("trip_id")
    assert rows(got) == [
        (0, "Friday", "Saturday", "Bronx", "Queens", "Acme", None),
        (1, None, None, None, None, None, None),
    ]


def test_export(spark, make_tables, tmp_path):
    t = make_tables([{"passenger_count": n} for n in (1, 1, None)])
    report = reports.passenger_analysis(t)
    export(report, str(tmp_path / "json"))
    lines = [
        json.loads(line)
        for part in Path(tmp_path / "json").glob("part-*")
        for line in part.read_text().splitlines()
    ]
    assert sorted(lines, key=repr) == [
        {"passenger_count": 1, "trip_count": 2},
        {"passenger_count": None, "trip_count": 1},
    ]
    export(report, str(tmp_path / "parquet"), "parquet")
    assert sorted(rows(spark.read.parquet(str(tmp_path / "parquet"))), key=repr) == sorted(rows(report), key=repr)
    with pytest.raises(ValueError):
        export(report, str(tmp_path / "x"), "xlsx")


def test_export_of_nested_key_figures(make_tables, tmp_path):
    t = make_tables([{"pickup": dt.datetime(2024, 11, 2), "total_amount": 8.0}])
    export(kpi.kpi_trends(t), str(tmp_path / "kpi"))
    (line,) = [x for p in Path(tmp_path / "kpi").glob("part-*") for x in p.read_text().splitlines()]
    record = json.loads(line)
    assert record["total_trips"] == {"current": 1.0, "previous": 0.0, "trend": 0.0}
    assert list(record) == ["total_trips", "avg_trips_per_period", "max_trips_per_period", "avg_amount_overall"]
