"""Data-quality checks on hand-made trips."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from farelens.operators import tables
from farelens.plans import quality
from tests.conftest import rows

NOON = dt.datetime(2024, 5, 10, 12)


def ride(**columns):
    return {"pickup": NOON, "dropoff": NOON + dt.timedelta(minutes=5), **columns}


def scores(tables_, **kwargs):
    return {r["dimension"]: r["score"] for r in quality.scorecard(tables_, **kwargs).collect()}


def test_completeness(make_tables):
    t = make_tables([ride(fare_amount=1.0, passenger_count=1), ride(fare_amount=2.0), ride(), ride()])
    got = dict(rows(quality.field_completeness(t)))
    assert list(got) == list(quality.COMPLETENESS_FIELDS)
    assert (got["fare_amount"], got["passenger_count"], got["total_amount"]) == (50.0, 25.0, 0.0)
    assert set(dict(rows(quality.field_completeness(make_tables()))).values()) == {None}


def test_scorecard_shape(make_tables):
    got = rows(quality.scorecard(make_tables([ride()])))
    assert [(r[0], r[2]) for r in got] == list(quality.TARGETS.items())
    assert {r[1] for r in rows(quality.scorecard(make_tables()))} == {None}


def test_validity_and_uniqueness(make_tables):
    t = make_tables([ride(trip_id=1), ride(trip_id=1), {"pickup": NOON, "trip_id": 2}, {"trip_id": 3}])
    got = scores(t)
    assert got["Validité"] == 50.0
    assert got["Unicité"] == 75.0


def test_validity_of_raw_texts_agrees_with_the_format_errors(spark, make_tables):
    texts = ["2024-05-01 10:00:00", "01/05/2024 10:00", None, "", "2024-05-02 10:00:00", "soon"]
    raw = spark.createDataFrame(list(enumerate(texts)), "trip_id long, pickup_datetime string")
    t = make_tables([ride(trip_id=i) for i in range(6)])
    errors = quality.format_errors(t, raw).count()
    assert scores(t, raw=raw)["Validité"] == 40.0 == 100 * (1 - errors / 5)
    assert scores(t, raw=raw, fmt="dd/MM/yyyy HH:mm")["Validité"] == 20.0
    assert scores(t, raw=raw.limit(0))["Validité"] is None
    assert [r[0] for r in rows(quality.scorecard(t, raw=raw))] == list(quality.TARGETS)


def test_timeliness_looks_back_thirty_days(make_tables):
    ages = [0, 29, 30, 30.001, 45]
    t = make_tables([{"pickup": NOON - dt.timedelta(days=age)} for age in ages] + [{}])
    assert scores(t)["Actualité"] == 60.0
    as_of = F.lit("2024-05-25 12:00:00")
    assert scores(t, as_of=as_of)["Actualité"] == 20.0


def test_consistency_needs_order_and_resolving_keys(make_tables):
    places = [{"location_key": 1}]
    vendors = [{"vendor_key": 1}]
    trips = [
        ride(),
        ride(vendor_key=1, pickup_location_key=1, dropoff_location_key=1),
        ride(dropoff=NOON),
        ride(vendor_key=2),
        ride(dropoff_location_key=9),
        ride(rate_code_key=1),
        ride(payment_type_key=1),
        ride(pickup_date_key=19990101),
        ride(dropoff=NOON - dt.timedelta(seconds=1)),
        {"pickup": NOON},
    ]
    t = make_tables(trips, dim_location=places, dim_vendor=vendors)
    assert scores(t)["Cohérence"] == 30.0


def test_precision_and_outliers(make_tables):
    fares = [float(i) for i in range(1, 10)] + [100.0, -50.0, None]
    t = make_tables([ride(fare_amount=f) for f in fares])
    assert scores(t)["Précision"] == pytest.approx(100 * 9 / 11)
    assert rows(quality.outliers(t)) == [(9, 100.0)]
    assert rows(quality.outliers(make_tables())) == []


def test_outlier_fence_is_exclusive(make_tables):
    # Quartiles 2 and 4: the fence is at 4 + 1.5 * 2 = 7.
    t = make_tables([ride(fare_amount=f) for f in (1.0, 2.0, 3.0, 4.0, 7.0)])
    assert rows(quality.outliers(t)) == []


def test_missing_duplicates_and_format_errors(spark, make_tables):
    t = make_tables(
        [ride(trip_id=1, passenger_count=2), ride(trip_id=1), {"trip_id": 2}, ride(trip_id=3), ride(trip_id=3)]
    )
    assert sorted(rows(quality.missing_values(t))) == [(1,), (2,), (3,), (3,)]
    assert rows(quality.missing_values(t, "tpep_pickup_datetime")) == [(2,)]
    assert sorted(rows(quality.duplicates(t))) == [(1, 2), (3, 2)]
    assert rows(quality.format_errors(t)) == [(2, None)]
    raw = spark.createDataFrame(
        [(1, "2024-05-01 10:00:00"), (2, "01/05/2024 10:00"), (3, None), (4, "2024-13-01 10:00:00"), (5, "")],
        "trip_id long, pickup_datetime string",
    )
    assert rows(quality.format_errors(t, raw)) == [(2, "01/05/2024 10:00"), (4, "2024-13-01 10:00:00"), (5, "")]
    french = quality.format_errors(t, raw, fmt="dd/MM/yyyy HH:mm")
    assert [r[0] for r in rows(french)] == [1, 4, 5]


def test_default_format_is_strict(spark, make_tables):
    texts = [
        "2024-05-01",
        "2024-05-01T10:00:00",
        "2024-05-01 10:00",
        "2024-05-01 10:00:00.5",
        "2024-05-01 10:00:00\n",
        " 2024-05-01 10:00:00",
        "2024-02-30 10:00:00",
        "2024-05-01 24:00:00",
        "2024-03-10 02:30:00",
        "2024-05-01 10:00:00",
    ]
    raw = spark.createDataFrame(list(enumerate(texts)), "trip_id long, pickup_datetime string")
    assert [r[1] for r in rows(quality.format_errors(make_tables(), raw))] == texts[:8]


def test_alerts(spark, make_tables):
    fares = [1.0, 2.0, 3.0, 4.0, 1000.0]
    t = make_tables([ride(trip_id=i % 4, fare_amount=f) for i, f in enumerate(fares)])
    raw = spark.createDataFrame([(1, "soon")], "trip_id long, pickup_datetime string")
    got = quality.alerts(t, raw)
    day = NOON.date()
    assert rows(got) == [
        (1, "high", "missing_values", "passenger_count", "5 trajets sans comptage passagers", day),
        (2, "medium", "duplicate", "trip_id", "1 identifiants de trajet dupliqués", day),
        (3, "medium", "format_error", "pickup_datetime", "1 dates au format incorrect", day),
        (4, "low", "outlier", "fare_amount", "1 trajets avec tarifs anormalement élevés", day),
    ]
    assert [r[0] for r in rows(tables.alert_page(got, page=1, size=3))] == [4]
    later = quality.alerts(t, as_of=F.lit(dt.date(2025, 1, 1)))
    assert {r["date"] for r in later.collect()} == {dt.date(2025, 1, 1)}


def test_no_alerts_on_clean_trips(make_tables):
    t = make_tables([ride(passenger_count=1, fare_amount=5.0)])
    assert rows(quality.alerts(t)) == []
