"""Physical plans: what is read, what is shuffled, what must not appear."""

from __future__ import annotations

import dataclasses
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from farelens.operators import tables
from farelens.operators.enrich import trips_enriched
from farelens.plans import kpi, quality, reports
from tests.conftest import TESTDATA

FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
)
# One task may only see data whose size does not follow the number of trips.
GROUPED_REPORTS = (
    "trip_volume",
    "financial_breakdown",
    "payment_analysis",
    "vendor_analysis",
    "rate_code_analysis",
    "hourly_activity",
    "passenger_analysis",
    "zone_activity",
    "borough_flows",
    "fare_efficiency",
    "kpi_trends",
    "kpi_window_totals",
    "kpi_busiest_month",
    "kpi_period_trend",
    "hourly_heatmap",
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan()


@pytest.fixture
def static_plans(spark):
    """Plain plans without broadcasts, as for dimensions too large for them."""
    wanted = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.maxMetadataStringLength": "5000",
    }
    saved = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in saved.items():
        spark.conf.set(k, v)


def paths(node, above=()):
    """Root-to-leaf paths of operator names, with the leaf's full text last."""
    children = node.children()
    if children.isEmpty():
        yield (*above, node.toString())
    for i in range(children.size()):
        yield from paths(children.apply(i), (*above, node.nodeName()))


# The corpus queries, where present, may use Python and have tests of their own.
CORPUS = registry.llm_queries.queries().keys() if registry.llm_queries else set()


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - CORPUS))
def test_no_cross_join_and_no_python(spark, name):
    text = plan_of(registry.queries()[name](spark, TESTDATA)).toString()
    assert not [bad for bad in FORBIDDEN if bad in text]


@pytest.mark.parametrize("name", GROUPED_REPORTS)
def test_trips_are_aggregated_before_any_shuffle_or_join(star, static_plans, name):
    fact_paths = [p for p in paths(plan_of(registry.REPORTS[name](star))) if "fact_trips" in p[-1]]
    assert fact_paths
    for path in fact_paths:
        marks = [n for n in reversed(path[:-1]) if "Aggregate" in n or "Exchange" in n or "Join" in n]
        assert "Aggregate" in marks[0], path


def scans(df):
    return [p[-1] for p in paths(plan_of(df)) if "fact_trips" in p[-1]]


def test_only_needed_columns_are_read(star, static_plans):
    (scan,) = scans(reports.hourly_activity(star))
    assert "ReadSchema: struct<tpep_pickup_datetime:timestamp_ntz>" in scan
    (scan,) = scans(reports.payment_analysis(star))
    assert "ReadSchema: struct<payment_type_key:int,tip_amount:double>" in scan


def test_filters_reach_the_scan(star, static_plans):
    (scan,) = scans(reports.trip_duration_stats(star, approx=True))
    assert "GreaterThan(trip_duration,PT0S)" in scan
    (scan,) = scans(quality.missing_values(star))
    assert "IsNull(passenger_count)" in scan


def test_years_read_only_their_partitions(star, static_plans):
    (scan,) = scans(reports.passenger_analysis(star, years=[1999]))
    assert "(partition_year" in scan and "= 1999)" in scan
    assert "ReadSchema: struct<passenger_count:int>" in scan


def test_key_figures_read_only_their_months(star, static_plans):
    (scan,) = scans(kpi.kpi_trends(star, year=2001, from_month=6))
    assert "(partition_year" in scan and "= 2001)" in scan and ">= 6)" in scan
    (scan,) = scans(kpi.kpi_period_trend(star, years=[1999]))
    assert "partition_year" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_top_flows_need_no_full_sort(star, static_plans):
    assert "TakeOrderedAndProject" in plan_of(reports.borough_flows(star)).toString()


def executed_fact_scans(spark, df):
    """Scans of the fact table that ran, reused parts counted once, from Spark's own record."""
    df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    executions = store.executionsList()
    run = executions.apply(executions.size() - 1)
    deadline = time.time() + 10
    while store.execution(run.executionId()).get().completionTime().isEmpty() and time.time() < deadline:
        time.sleep(0.1)
    nodes = store.planGraph(run.executionId()).allNodes()
    described = [nodes.apply(i).desc() for i in range(nodes.size())]
    return len([d for d in described if d.startswith("FileScan") and "partition_month#" in d])


@pytest.mark.parametrize(
    ("report", "expected"),
    [
        # sketch, brackets
        (reports.trip_duration_stats, 2),
        (lambda t: kpi.kpi_busiest_month(t, year=2001, from_month=6), 1),
        # sketch, brackets, the trips above the fence
        (quality.outliers, 3),
        # sketch with field counts and latest pickup; brackets; fence, keys and fresh trips. Ids are apart.
        (quality.scorecard, 3),
        # sketch with missing values and latest pickup; brackets; trips above the fence; lost pickups. Ids are apart.
        (quality.alerts, 4),
    ],
)
def test_shared_parts_are_computed_once(spark, star, report, expected):
    assert executed_fact_scans(spark, report(star)) == expected


def nodes_of(node):
    yield node
    for i in range(node.children().size()):
        yield from nodes_of(node.children().apply(i))


def test_ids_in_buckets_are_counted_without_a_shuffle(spark, star, static_plans):
    report = quality.duplicates(star)
    assert not [n for n in nodes_of(plan_of(report)) if "Exchange" in n.nodeName()]
    plain = quality.duplicates(dataclasses.replace(star, trip_ids=None))
    assert [n for n in nodes_of(plan_of(plain)) if "Exchange" in n.nodeName()]
    assert sorted(report.collect()) == sorted(plain.collect()) != []


def test_consistency_joins_no_trips(star, static_plans):
    fact_paths = [p for p in paths(plan_of(quality.scorecard(star))) if "fact_trips" in p[-1]]
    assert fact_paths
    for path in fact_paths:
        marks = [n for n in reversed(path[:-1]) if "Aggregate" in n or "Join" in n]
        assert "Aggregate" in marks[0], path


@pytest.mark.parametrize("name", sorted(registry.DAILY_REPORTS))
def test_daily_reports_read_no_trips(spark, name):
    days = registry.stage_daily(spark, TESTDATA)
    report = registry.DAILY_REPORTS[name](days)
    assert executed_fact_scans(spark, report) == 0


def test_pages_by_key_sort_no_more_than_a_page(star):
    flows = reports.borough_flows(star, top_n=None)
    last = {"trip_count": 10, "pickup_borough": "ASIA", "dropoff_borough": "ASIA"}
    assert "TakeOrderedAndProject" in plan_of(tables.flow_page_after(flows, last)).toString()


def test_a_hot_vendor_is_split_when_vendors_cannot_be_broadcast(spark, star):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    saved = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    hot = F.when(F.col("trip_id") % 3 > 0, F.lit(7)).otherwise(F.col("vendor_key"))
    skewed = dataclasses.replace(star, fact_trips=star.fact_trips.withColumn("vendor_key", hot))
    df = trips_enriched(skewed).select("trip_id", "vendor_name")
    got = df.collect()
    text = plan_of(df).toString()
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in text
    assert len(got) == star.fact_trips.count()
