"""The stored daily table: equal to the trips, refreshed by month, merged sketches near the exact ranks."""

from __future__ import annotations

import bisect
import dataclasses
import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from farelens.functions.durations import elapsed_seconds
from farelens.operators.reshape import period_rollup
from farelens.plans import daily, reports
from tests.conftest import rows


@pytest.fixture
def path(star, tmp_path):
    root = f"{tmp_path}/daily"
    daily.write_daily(star, root)
    return root


def files(root):
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in Path(root).rglob("*.parquet")}


@pytest.mark.parametrize("period", ["day", "week", "month", "quarter", "year"])
def test_rollups_equal_those_of_the_trips(spark, star, path, period):
    days = daily.load_daily(spark, path)
    assert rows(daily.volume(days, period)) == rows(reports.trip_volume(star, period=period, stable=True))
    assert rows(daily.breakdown(days, period)) == rows(reports.financial_breakdown(star, period=period, stable=True))


def test_exact_rollup_weighs_known_values_only(make_tables):
    day = [dt.datetime(2024, 5, 6, 9), dt.datetime(2024, 5, 7, 9)]
    t = make_tables(
        [{"pickup": day[0], "total_amount": v} for v in (10.0, None, None)] + [{"pickup": day[1], "total_amount": 40.0}]
    )
    states = daily.daily_states(t)
    exact = rows(period_rollup(states, "week", exact=True))
    assert exact[0][:3] == (dt.date(2024, 5, 6), 4, 25.0)
    weighted = rows(period_rollup(daily.volume(states), "week", stable=True))
    assert weighted[0][:3] == (dt.date(2024, 5, 6), 4, 17.5)


def test_a_refresh_touches_one_month(spark, star, path):
    before = files(path)
    without = star.fact_trips.where("NOT (partition_year = 1997 AND partition_month = 3)")
    changed = dataclasses.replace(star, fact_trips=without.withColumn("total_amount", F.lit(1.0)))
    daily.refresh_daily(changed, path, [(1997, 3), (1999, 12)])
    after = files(path)
    touched = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert {f.rsplit("/", 1)[0] for f in touched} == {"year=1997/month=3", "year=1999/month=12"}
    months = {r["date"]: r for r in daily.volume(daily.load_daily(spark, path), "month").collect()}
    assert dt.date(1997, 3, 1) not in months  # all its trips are gone
    assert months[dt.date(1999, 12, 1)]["avg_total_amount"] == 1.0
    original = {r["date"]: r for r in reports.trip_volume(star, period="month", stable=True).collect()}
    assert months[dt.date(1999, 11, 1)] == original[dt.date(1999, 11, 1)]


def test_a_refresh_reads_its_months_only(star, path):
    states = daily.daily_states(star, [(1997, 3)])
    plan = states._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line and "partition_month#" in line]
    assert scan and all("partition_year" in line.split("PartitionFilters")[1] for line in scan)


@pytest.mark.parametrize("years", [None, [1996, 1999]])
def test_sketched_quantiles_have_nearly_the_wanted_rank(spark, star, path, years):
    days = daily.load_daily(spark, path)
    chosen = days if years is None else days.where(F.col("year").isin(years))
    trips = star.fact_trips if years is None else star.fact_trips.where(F.col("partition_year").isin(years))
    seconds = sorted(
        r[0] for r in trips.select(elapsed_seconds(F.col("trip_duration")).alias("s")).where("s > 0").collect()
    )
    for fraction, value in daily.duration_quantiles(chosen, (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)).collect():
        low, high = bisect.bisect_left(seconds, value) / len(seconds), bisect.bisect_right(seconds, value) / len(seconds)
        assert low - 0.02 <= fraction <= high + 0.02


def test_no_trips(make_tables):
    states = daily.daily_states(make_tables())
    assert daily.volume(states).count() == 0
    assert {r["seconds"] for r in daily.duration_quantiles(states).collect()} == {None}
