"""Roll-ups, chart series and result tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from farelens.operators import reshape, tables
from farelens.operators.calendar import calendar, calendar_of
from farelens.plans import reports
from tests.conftest import rows

DAILY = (
    "date date, trip_count long, avg_total_amount double, avg_tip_amount double,"
    " avg_trip_distance double, avg_trip_duration_seconds double"
)


@pytest.fixture
def daily(spark):
    def build(*days):
        data = [(dt.date.fromisoformat(d), n, *([mean] * 4)) for d, n, mean in days]
        return spark.createDataFrame(data, DAILY)

    return build


def test_year_filter(daily):
    d = daily(("2025-02-01", 1, 1.0), ("2024-12-31", 2, 1.0), ("2023-01-01", 3, 1.0))
    assert [r[1] for r in rows(reshape.year_filter(d))] == [2]
    assert [r[1] for r in rows(reshape.year_filter(d, [2023, 2025]))] == [3, 1]
    assert [r[1] for r in rows(reshape.year_filter(d, []))] == [3, 2, 1]


def test_weeks_start_on_monday_across_the_year_end(daily):
    d = daily(("2024-12-29", 1, 1.0), ("2024-12-30", 2, 1.0), ("2025-01-01", 3, 2.0), ("2025-01-05", 5, 4.0))
    assert [r[:3] for r in rows(reshape.period_rollup(d, "week"))] == [
        (dt.date(2024, 12, 23), 1, 1.0),
        (dt.date(2024, 12, 30), 10, 2.8),
    ]


def test_rollup_weighs_means_by_trips(daily):
    d = daily(("2024-01-01", 1, 10.0), ("2024-03-31", 3, 2.0), ("2024-04-01", 0, 7.0))
    got = [r[:3] for r in rows(reshape.period_rollup(d, "quarter"))]
    assert got == [(dt.date(2024, 1, 1), 4, 4.0), (dt.date(2024, 4, 1), 0, 0.0)]
    assert rows(reshape.period_rollup(d, "quarter", stable=True)) == rows(reshape.period_rollup(d, "quarter"))
    assert rows(reshape.period_rollup(d, "day")) == rows(d.orderBy("date"))
    with pytest.raises(ValueError):
        reshape.period_rollup(d, "fortnight")


def test_rollup_keeps_the_number_of_trips(star):
    daily_volume = reports.trip_volume(star)
    total = daily_volume.agg(F.sum("trip_count")).first()[0]
    for period in ("week", "month", "quarter", "year"):
        assert reshape.period_rollup(daily_volume, period).agg(F.sum("trip_count")).first()[0] == total


def test_monthly_distribution_rounds_half_up(daily):
    d = daily(("2024-03-01", 2, 1.0), ("2025-03-09", 3, 1.0), ("2024-07-01", 4, 1.0))
    got = rows(reshape.monthly_distribution(d))
    assert [m for m, _ in got] == list(range(1, 13))
    assert {m: n for m, n in got if n} == {3: 3, 7: 4}


def test_heatmap(spark):
    hourly = spark.createDataFrame(
        [(1, 0, 10), (7, 23, 5), (2, 5, 0), (None, None, 99)],
        "day_of_week int, hour_of_day int, trip_count long",
    )
    assert rows(reshape.hourly_heatmap(hourly)) == [(0, 0, 10, 1.0), (5, 1, 0, 0.0), (23, 6, 5, 0.1 + 0.5 * 0.9)]
    dense = rows(reshape.hourly_heatmap(hourly, dense=True))
    assert len(dense) == 168
    assert [r for r in dense if r[2]] == [(0, 0, 10, 1.0), (23, 6, 5, 0.1 + 0.5 * 0.9)]


def test_trend_series(daily):
    d = daily(("2024-01-01", 2, 1.5))
    day = dt.date(2024, 1, 1)
    assert rows(reshape.trend_series(d)) == [(day, "avg_total_amount", 1.5), (day, "trip_count", 2.0)]
    assert rows(reshape.trend_series(d, ["avg_tip_amount"])) == [(day, "avg_tip_amount", 1.5)]
    with pytest.raises(ValueError):
        reshape.trend_series(d, ["profit"])


def test_financial_series_leaves_out_the_total(star):
    breakdown = reports.financial_breakdown(star)
    got = reshape.financial_series(breakdown, [1997])
    assert got.columns == ["date", "component", "amount"]
    assert {r[0].year for r in rows(got)} == {1997}
    assert {r[1] for r in rows(got)} == set(reshape.FEE_COMPONENTS)
    assert reshape.financial_series(breakdown, None).count() == 6 * breakdown.count()


def test_passenger_labels(spark):
    df = spark.createDataFrame([(0, 4), (None, 2)], "passenger_count int, trip_count long")
    assert rows(reshape.passenger_labels(df)) == [("0", 4), ("Inconnu", 2)]


def test_pages_cover_a_report_once(daily):
    d = daily(*[(f"2024-01-{i:02d}", i, 1.0) for i in range(1, 26)])
    pages = [rows(tables.volume_page(d, page)) for page in range(4)]
    assert [len(p) for p in pages] == [10, 10, 5, 0]
    assert [r[1] for p in pages for r in p] == list(range(25, 0, -1))
    with pytest.raises(ValueError):
        tables.volume_page(d, -1)


FLOWS = [("Bronx", "Queens", 5, 1.0), ("Queens", "Manhattan", 7, 1.0), ("Staten Island", "Bronx", 5, 1.0)]


def test_flow_pages_and_search(spark):
    flows = spark.createDataFrame(FLOWS, "pickup_borough string, dropoff_borough string, trip_count long, avg_fare_amount double")
    assert [r[0] for r in rows(tables.flow_page(flows))] == ["Queens", "Bronx", "Staten Island"]
    assert [r[0] for r in rows(tables.flow_page(flows, page=1, size=2))] == ["Staten Island"]
    assert [r[0] for r in rows(tables.flow_search(flows, pickup="EN"))] == ["Queens", "Staten Island"]
    assert [r[0] for r in rows(tables.flow_search(flows, pickup="en", dropoff="bro"))] == ["Staten Island"]
    assert tables.flow_search(flows).count() == 3


def test_calendar(spark):
    days = calendar(spark, dt.date(2024, 2, 28), dt.date(2024, 3, 3))
    assert rows(days)[1] == (20240229, dt.date(2024, 2, 29), 2024, 2, 29, 4, "Thursday", "February", 1, False)
    assert [r["day_of_week"] for r in days.collect()] == [3, 4, 5, 6, 7]
    assert [r["is_weekend"] for r in days.collect()] == [False, False, False, True, True]
    assert calendar(spark, dt.date(2024, 3, 1), dt.date(2024, 2, 1)).count() == 0
    assert rows(calendar_of(days, "full_date")) == rows(days)
    assert calendar_of(days.limit(0), "full_date").count() == 0


def test_pages_by_key_equal_pages_by_offset(spark):
    flows = spark.createDataFrame(
        [(n, p, d) for n in (None, 5, 5, 9, 1) for p in ("A", None, "B") for d in ("x", "y")],
        "trip_count long, pickup_borough string, dropoff_borough string",
    ).distinct()
    order = [F.desc("trip_count"), F.asc("pickup_borough"), F.asc("dropoff_borough")]
    last, seen = None, []
    for page in range(7):
        by_key = rows(tables.flow_page_after(flows, last, size=4))
        assert by_key == rows(tables.paged_table(flows, order, page, 4))
        seen += by_key
        if by_key:
            last = dict(zip(flows.columns, by_key[-1]))
    assert len(seen) == flows.count() == 24
    with pytest.raises(ValueError):
        tables.flow_page_after(flows, size=0)
