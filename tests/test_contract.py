"""Column names and types of every report."""

from __future__ import annotations

import pytest

from farelens.plans import kpi, quality, reports

VOLUME = (
    "date:date,trip_count:bigint,avg_total_amount:double,avg_tip_amount:double,"
    "avg_trip_distance:double,avg_trip_duration_seconds:double"
)
VALUE = "struct<current:double,previous:double,trend:double>"

CONTRACT = {
    reports.trip_volume: VOLUME,
    reports.payment_analysis: "payment_type_name:string,trip_count:bigint,avg_tip_amount:double",
    reports.hourly_activity: "day_of_week:int,hour_of_day:int,trip_count:bigint",
    reports.passenger_analysis: "passenger_count:int,trip_count:bigint",
    reports.financial_breakdown: (
        "date:date,avg_fare_amount:double,avg_tip_amount:double,avg_tolls_amount:double,avg_mta_tax:double,"
        "avg_improvement_surcharge:double,avg_extra:double,avg_total_amount:double"
    ),
    reports.vendor_analysis: (
        "vendor_name:string,trip_count:bigint,avg_total_amount:double,avg_trip_distance:double"
    ),
    reports.rate_code_analysis: (
        "rate_code_name:string,trip_count:bigint,avg_total_amount:double,avg_trip_distance:double,"
        "avg_tip_amount:double"
    ),
    reports.trip_duration_stats: ",".join(
        f"{figure}_duration_seconds:double" for figure in ("avg", "min", "max", "p25", "p50", "p75")
    ),
    reports.fare_efficiency: "avg_fare_per_km:double,avg_fare_per_minute:double",
    reports.zone_activity: (
        "location_id:int,zone:string,borough:string,trip_count:bigint,avg_total_amount:double"
    ),
    reports.borough_flows: (
        "pickup_borough:string,dropoff_borough:string,trip_count:bigint,avg_fare_amount:double"
    ),
    kpi.kpi_trends: ",".join(
        f"{name}:{VALUE}"
        for name in ("total_trips", "avg_trips_per_period", "max_trips_per_period", "avg_amount_overall")
    ),
    kpi.kpi_window_totals: "date:date,trip_count:bigint,avg_total_amount:double",
    kpi.kpi_busiest_month: VOLUME,
    quality.field_completeness: "field:string,pct:double",
    quality.scorecard: "dimension:string,score:double,target:double",
    quality.alerts: "id:int,severity:string,type:string,field:string,message:string,date:date",
}
WITH_STABLE = [r for r in CONTRACT if "stable" in (r.__kwdefaults__ or {})]


@pytest.mark.parametrize("report", CONTRACT, ids=lambda r: r.__name__)
def test_columns_and_types(star, report):
    assert report(star).schema.simpleString() == f"struct<{CONTRACT[report]}>"


@pytest.mark.parametrize("report", WITH_STABLE, ids=lambda r: r.__name__)
def test_stable_means_have_the_same_types(star, report):
    assert report(star, stable=True).schema.simpleString() == report(star).schema.simpleString()
