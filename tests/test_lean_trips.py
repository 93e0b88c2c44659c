"""Reports on the test tables move the columns they need and store no trips."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest

import __spark_entry__ as registry
from farelens.sources.driver_star import derive_star, stage_star
from tests.conftest import TESTDATA, rows
from tests.test_plans import nodes_of, plan_of, static_plans  # noqa: F401


@pytest.mark.parametrize("name, written", [("trip_volume_month", set()), ("monthly_distribution", {"daily"})])
def test_reports_store_no_trips(spark, tmp_path, name, written):
    fresh = shutil.copytree(TESTDATA, tmp_path / "tables")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir()) if shared.exists() else set()
    assert registry.queries()[name](spark, str(fresh)).count() > 0
    new = set(shared.iterdir()) - before if shared.exists() else set()
    assert {p.name for folder in new for p in folder.iterdir()} == written


def test_line_items_are_narrow_when_shuffled(spark, static_plans):  # noqa: F811
    report = registry.queries()["trip_volume_month"](spark, TESTDATA)
    moved = [n for n in nodes_of(plan_of(report)) if "Exchange" in n.nodeName() and "l_orderkey" in n.output().toString()]
    assert moved
    for node in moved:
        assert node.output().size() <= 8


def test_stored_trips_equal_derived_ones(spark):
    derived, stored = derive_star(spark, TESTDATA).fact_trips, stage_star(spark, TESTDATA).fact_trips
    assert sorted(rows(stored.select(*derived.columns)), key=repr) == sorted(rows(derived), key=repr)
