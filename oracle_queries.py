"""DuckDB SQL for the registered queries, over the driver's tables.

STAR derives the same star schema as farelens.sources.driver_star, by the rules in FIXTURES.md.
Means are sums of whole multiples of 2**-88, exact like the library's ``stable=True`` form.
"""

from __future__ import annotations

STAR = """
WITH placed AS (
    SELECT l.*, o.o_orderpriority, c.c_nationkey, s.s_nationkey,
        o.o_orderdate + to_seconds(cast((l_partkey * 7919 + l_suppkey * 613 + l_linenumber * 3571) % 86400 AS bigint)) AS pk,
        cast((l_partkey * 31 + l_suppkey * 17 + cast(l_quantity AS bigint) * 60) % 5400 - 60 AS bigint) AS dur,
        floor(l_extendedprice / 10) AS fc,
        floor(floor(l_extendedprice / 10) * round(l_discount * 100) / 100) AS tc,
        round(l_tax * 1000) AS xc
    FROM lineitem l
    JOIN orders o ON l_orderkey = o_orderkey
    JOIN customer c ON o_custkey = c_custkey
    JOIN supplier s ON l_suppkey = s_suppkey
), timed AS (
    SELECT *, pk + to_seconds(dur) AS dk FROM placed
), fact_trips AS (
    SELECT
        l_orderkey * 10 + l_linenumber AS trip_id,
        cast(CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_suppkey END AS int) AS vendor_key,
        cast(strftime(pk, '%Y%m%d') AS int) AS pickup_date_key,
        cast(strftime(dk, '%Y%m%d') AS int) AS dropoff_date_key,
        CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE c_nationkey END AS pickup_location_key,
        s_nationkey AS dropoff_location_key,
        l_linenumber AS rate_code_key,
        cast(substring(o_orderpriority, 1, 1) AS int) AS payment_type_key,
        CASE WHEN l_returnflag = 'A' THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
        pk AS tpep_pickup_datetime,
        dk AS tpep_dropoff_datetime,
        CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_linenumber - 1 END AS passenger_count,
        (l_quantity - 1) / 2.0 AS trip_distance,
        fc / 100e0 AS fare_amount,
        xc / 100e0 AS extra,
        0.5e0 AS mta_tax,
        CASE WHEN l_returnflag = 'R' THEN NULL ELSE tc / 100e0 END AS tip_amount,
        cast(CASE WHEN l_linestatus = 'O' THEN 6.55 ELSE 0 END AS double) AS tolls_amount,
        1.0e0 AS improvement_surcharge,
        CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE (fc + xc + 150
            + CASE WHEN l_returnflag = 'R' THEN 0 ELSE tc END
            + CASE WHEN l_linestatus = 'O' THEN 655 ELSE 0 END) / 100e0 END AS total_amount,
        2.5e0 AS congestion_surcharge,
        0e0 AS airport_fee,
        CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE dk - pk END AS trip_duration
    FROM timed
), dim_date AS (
    SELECT
        cast(strftime(d, '%Y%m%d') AS int) AS date_key,
        cast(d AS date) AS full_date,
        cast(year(d) AS int) AS year,
        cast(month(d) AS int) AS month,
        cast(day(d) AS int) AS day,
        cast(isodow(d) AS int) AS day_of_week,
        dayname(d) AS day_name,
        monthname(d) AS month_name,
        cast(quarter(d) AS int) AS quarter,
        isodow(d) >= 6 AS is_weekend
    FROM range(timestamp '1995-01-01', timestamp '2002-01-01', interval 1 day) days(d)
), dim_location AS (
    SELECT n_nationkey AS location_key, n_nationkey AS location_id,
        CASE n_nationkey WHEN 24 THEN NULL WHEN 23 THEN 'Unknown' WHEN 22 THEN '' ELSE r_name END AS borough,
        n_name AS zone, cast(NULL AS varchar) AS service_zone
    FROM nation JOIN region ON n_regionkey = r_regionkey
), dim_vendor AS (
    SELECT cast(s_suppkey AS int) AS vendor_key, cast(s_suppkey AS int) AS vendor_id,
        CASE s_suppkey % 10 WHEN 0 THEN '   ' WHEN 1 THEN NULL ELSE ' ' || s_name END AS vendor_name
    FROM supplier
), dim_payment_type AS (
    SELECT * FROM (VALUES (1, 1, 'Credit card'), (2, 2, 'Cash'), (3, 3, 'No charge'), (4, 4, NULL))
        t(payment_type_key, payment_type_id, payment_type_name)
), dim_rate_code AS (
    SELECT * FROM (VALUES (1, 1, 'Standard'), (2, 2, 'JFK'), (3, 3, 'Newark'), (4, 4, 'Nassau'),
        (5, 5, 'Negotiated'), (6, 6, 'Group')) t(rate_code_key, rate_code_id, rate_code_name)
)"""


UNIT = "3.09485009821345068724781056e26"  # 2**88


def total(column: str) -> str:
    # By way of text, which DuckDB turns into the nearest double.
    return f"cast(cast(sum(cast(cast({column} AS double) * {UNIT} AS hugeint)) AS varchar) AS double) / {UNIT}"


def mean(column: str, alias: str) -> str:
    return f"coalesce({total(column)} / nullif(count({column}), 0), 0.0) AS {alias}"


SECONDS = "epoch(f.trip_duration)"
VOLUME_MEANS = ", ".join(
    [
        mean("f.total_amount", "avg_total_amount"),
        mean("f.tip_amount", "avg_tip_amount"),
        mean("f.trip_distance", "avg_trip_distance"),
        mean(SECONDS, "avg_trip_duration_seconds"),
    ]
)
FEE_MEANS = ", ".join(
    mean(f"f.{c}", f"avg_{c}")
    for c in (
        "fare_amount",
        "tip_amount",
        "tolls_amount",
        "mta_tax",
        "improvement_surcharge",
        "extra",
        "total_amount",
    )
)


def volume(period: str = "day") -> str:
    return f"""
    SELECT cast(date_trunc('{period}', d.full_date) AS date) AS date, count(f.trip_id) AS trip_count, {VOLUME_MEANS}
    FROM fact_trips f JOIN dim_date d ON f.pickup_date_key = d.date_key GROUP BY 1"""


def breakdown(period: str = "month") -> str:
    return f"""
    SELECT cast(date_trunc('{period}', d.full_date) AS date) AS date, {FEE_MEANS}
    FROM fact_trips f JOIN dim_date d ON f.pickup_date_key = d.date_key GROUP BY 1"""


def payment(where: str = "true") -> str:
    return f"""
    SELECT coalesce(p.payment_type_name, 'Inconnu') AS payment_type_name, trip_count, avg_tip_amount FROM (
        SELECT pt.payment_type_name, count(f.trip_id) AS trip_count, {mean("f.tip_amount", "avg_tip_amount")}
        FROM fact_trips f LEFT JOIN dim_payment_type pt ON f.payment_type_key = pt.payment_type_key
        WHERE {where} GROUP BY pt.payment_type_name) p"""


HOURLY = """
    SELECT cast(isodow(tpep_pickup_datetime) AS int) AS day_of_week,
        cast(hour(tpep_pickup_datetime) AS int) AS hour_of_day, count(trip_id) AS trip_count
    FROM fact_trips GROUP BY 1, 2"""

PASSENGERS = "SELECT passenger_count, count(trip_id) AS trip_count FROM fact_trips GROUP BY 1"

ALL_FLOWS = f"""
    SELECT p.borough AS pickup_borough, d.borough AS dropoff_borough, count(f.trip_id) AS trip_count,
        {mean("f.fare_amount", "avg_fare_amount")}
    FROM fact_trips f
    LEFT JOIN dim_location p ON f.pickup_location_key = p.location_key
    LEFT JOIN dim_location d ON f.dropoff_location_key = d.location_key
    WHERE p.borough IS NOT NULL AND d.borough IS NOT NULL
        AND p.borough NOT IN ('Unknown', '') AND d.borough NOT IN ('Unknown', '')
    GROUP BY 1, 2 ORDER BY trip_count DESC, 1, 2"""

FLOWS = f"{ALL_FLOWS} LIMIT 100"


def rollup(period: str) -> str:
    def weighted(column: str) -> str:
        return (
            f"round({total(f'{column} * trip_count')}"
            f" / greatest(sum(trip_count), 1), 6) AS {column}"
        )

    means = ", ".join(
        weighted(c)
        for c in ("avg_total_amount", "avg_tip_amount", "avg_trip_distance", "avg_trip_duration_seconds")
    )
    return f"""
    SELECT cast(date_trunc('{period}', date) AS date) AS date, cast(sum(trip_count) AS bigint) AS trip_count, {means}
    FROM ({volume()}) v GROUP BY 1"""


WINDOW_MONTHS = f"""
    SELECT cast(date_trunc('month', d.full_date) AS date) AS date, max(d.full_date) AS last_day,
        count(f.trip_id) AS trip_count, {VOLUME_MEANS}
    FROM fact_trips f RIGHT JOIN dim_date d ON f.pickup_date_key = d.date_key
    WHERE d.year = 2001 AND d.month >= 6 GROUP BY 1"""

WINDOW_TOTALS = f"""
    SELECT max(d.full_date) AS date, count(f.trip_id) AS trip_count, {mean("f.total_amount", "avg_total_amount")}
    FROM fact_trips f RIGHT JOIN dim_date d ON f.pickup_date_key = d.date_key
    WHERE d.year = 2001 AND d.month >= 6"""

KPI_NAMES = ("total_trips", "avg_trips_per_period", "max_trips_per_period", "avg_amount_overall")
KPI_VALUES = (
    "cast(t.trip_count AS double)",
    "t.trip_count / 7e0",
    "cast(m.busiest AS double)",
    "t.avg_total_amount",
)
KPI_COLUMNS = ", ".join(
    f"{value} AS {name}_current, 0e0 AS {name}_previous, 0e0 AS {name}_trend"
    for name, value in zip(KPI_NAMES, KPI_VALUES)
)


def period_trend(period: str, where: str = "true") -> str:
    return f"""
    SELECT date, trip_count, avg_total_amount, previous_trip_count,
        (trip_count - previous_trip_count) * 100e0 / nullif(previous_trip_count, 0) AS trip_count_trend,
        previous_avg_total_amount,
        (avg_total_amount - previous_avg_total_amount) * 100e0 / nullif(previous_avg_total_amount, 0)
            AS avg_total_amount_trend
    FROM (SELECT *, lag(trip_count) OVER (ORDER BY date) AS previous_trip_count,
            lag(avg_total_amount) OVER (ORDER BY date) AS previous_avg_total_amount
        FROM (SELECT cast(date_trunc('{period}', d.full_date) AS date) AS date, count(f.trip_id) AS trip_count,
                {mean("f.total_amount", "avg_total_amount")}
            FROM fact_trips f RIGHT JOIN dim_date d ON f.pickup_date_key = d.date_key GROUP BY 1))
    WHERE {where}"""


COMPLETENESS = {
    "pickup_location": "pickup_location_key",
    "dropoff_location": "dropoff_location_key",
    "passenger_count": "passenger_count",
    "trip_distance": "trip_distance",
    "fare_amount": "fare_amount",
    "tip_amount": "tip_amount",
    "total_amount": "total_amount",
}
FIELD_PCT = " UNION ALL ".join(
    f"SELECT '{field}' AS field, 100e0 * count({c}) / nullif(count(*), 0) AS pct FROM fact_trips"
    for field, c in COMPLETENESS.items()
)
MEAN_PCT = " + ".join(f"100e0 * count({c}) / nullif(count(*), 0)" for c in COMPLETENESS.values())

def fence(column: str) -> str:
    return f"""
    SELECT q[1] - (q[2] - q[1]) * 1.5e0 AS lower, q[2] + (q[2] - q[1]) * 1.5e0 AS upper
    FROM (SELECT quantile_cont({column}, [0.25, 0.75]) AS q FROM fact_trips)"""


def outliers(column: str) -> str:
    return f"""
    SELECT trip_id, {column} FROM fact_trips WHERE {column} > (SELECT upper FROM ({fence(column)}))"""


FENCE = fence("fare_amount")
OUTLIERS = outliers("fare_amount")

DUPLICATES = "SELECT trip_id, count(*) AS occurrences FROM fact_trips GROUP BY 1 HAVING count(*) > 1"

RAW_PICKUPS = """
        SELECT trip_id, CASE WHEN trip_id % 29 = 0 THEN NULL WHEN trip_id % 23 = 0 THEN 'n/a'
            WHEN trip_id % 19 = 0 THEN strftime(tpep_pickup_datetime, '%d/%m/%Y %H:%M')
            ELSE strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M:%S') END AS pickup_datetime
        FROM fact_trips"""

FORMAT_ERRORS = f"""
    SELECT trip_id, pickup_datetime AS raw_value FROM ({RAW_PICKUPS})
    WHERE pickup_datetime IS NOT NULL AND try_strptime(pickup_datetime, '%Y-%m-%d %H:%M:%S') IS NULL"""

MISSING = "SELECT trip_id FROM fact_trips WHERE passenger_count IS NULL"

CONSISTENT = """
    f.tpep_dropoff_datetime >= f.tpep_pickup_datetime
    AND (f.pickup_date_key IS NULL OR f.pickup_date_key IN (SELECT date_key FROM dim_date))
    AND (f.dropoff_date_key IS NULL OR f.dropoff_date_key IN (SELECT date_key FROM dim_date))
    AND (f.pickup_location_key IS NULL OR f.pickup_location_key IN (SELECT location_key FROM dim_location))
    AND (f.dropoff_location_key IS NULL OR f.dropoff_location_key IN (SELECT location_key FROM dim_location))
    AND (f.rate_code_key IS NULL OR f.rate_code_key IN (SELECT rate_code_key FROM dim_rate_code))
    AND (f.payment_type_key IS NULL OR f.payment_type_key IN (SELECT payment_type_key FROM dim_payment_type))
    AND (f.vendor_key IS NULL OR f.vendor_key IN (SELECT vendor_key FROM dim_vendor))"""

VALIDITY = """100e0 * count_if(tpep_pickup_datetime IS NOT NULL
        AND tpep_dropoff_datetime IS NOT NULL) / nullif(count(*), 0), 98e0 FROM fact_trips"""
RAW_VALIDITY = f"""100e0 * count(try_strptime(pickup_datetime, '%Y-%m-%d %H:%M:%S'))
        / nullif(count(pickup_datetime), 0), 98e0 FROM ({RAW_PICKUPS})"""


def scorecard(validity: str) -> str:
    return f"""
    SELECT 'Complétude' AS dimension, ({MEAN_PCT}) / 7 AS score, 99e0 AS target FROM fact_trips
    UNION ALL SELECT 'Validité', {validity}
    UNION ALL SELECT 'Unicité', 100e0 * count(DISTINCT trip_id) / nullif(count(*), 0), 100e0 FROM fact_trips
    UNION ALL SELECT 'Cohérence', 100e0 * count_if({CONSISTENT}) / nullif(count(*), 0), 95e0 FROM fact_trips f
    UNION ALL SELECT 'Actualité', 100e0 * count_if(tpep_pickup_datetime BETWEEN until - interval 30 day AND until)
        / nullif(count(tpep_pickup_datetime), 0), 95e0
        FROM (SELECT tpep_pickup_datetime, max(tpep_pickup_datetime) OVER () AS until FROM fact_trips)
    UNION ALL SELECT 'Précision', 100e0 * count_if(fare_amount BETWEEN (SELECT lower FROM ({FENCE}))
        AND (SELECT upper FROM ({FENCE}))) / nullif(count(fare_amount), 0), 95e0 FROM fact_trips"""


ALERTS = f"""
    SELECT cast(row_number() OVER (ORDER BY rank, type) AS int) AS id, severity, type, field, message, date
    FROM (
        SELECT 1 AS rank, 'high' AS severity, 'missing_values' AS type, 'passenger_count' AS field,
            count(*) || ' trajets sans comptage passagers' AS message, count(*) AS n FROM ({MISSING})
        UNION ALL SELECT 2, 'medium', 'format_error', 'pickup_datetime',
            count(*) || ' dates au format incorrect', count(*) FROM ({FORMAT_ERRORS})
        UNION ALL SELECT 3, 'low', 'outlier', 'fare_amount',
            count(*) || ' trajets avec tarifs anormalement élevés', count(*) FROM ({OUTLIERS})
        UNION ALL SELECT 2, 'medium', 'duplicate', 'trip_id',
            count(*) || ' identifiants de trajet dupliqués', count(*) FROM ({DUPLICATES})
    ), (SELECT cast(max(tpep_pickup_datetime) AS date) AS date FROM fact_trips)
    WHERE n > 0"""

HEATMAP = f"""
    SELECT hour_of_day AS x, day_of_week - 1 AS y, trip_count AS v,
        CASE WHEN trip_count = 0 THEN 0e0 ELSE least(0.1e0 + cast(trip_count AS double)
            / cast(max(trip_count) OVER () AS double) * 0.9e0, 1e0) END AS intensity
    FROM ({HOURLY}) h WHERE day_of_week IS NOT NULL"""

HEATMAP_DENSE = f"""
    SELECT cast(gx.x AS int) AS x, cast(gy.y AS int) AS y, coalesce(v, 0) AS v, coalesce(intensity, 0e0) AS intensity
    FROM range(24) gx(x) CROSS JOIN range(7) gy(y) LEFT JOIN ({HEATMAP}) h ON h.x = gx.x AND h.y = gy.y"""

HEATMAP_VENDOR = HEATMAP_DENSE.replace("FROM fact_trips GROUP BY", "FROM fact_trips WHERE vendor_key = 7 GROUP BY")

DAYS_IN_ROLES = ", ".join(
    f"{role}_d.{c} AS {role}_{c}"
    for role in ("pickup", "dropoff")
    for c in ("full_date", "year", "month", "day", "day_of_week", "day_name", "month_name", "quarter", "is_weekend")
)
PLACES_IN_ROLES = ", ".join(
    f"{role}_l.{c} AS {role}_{c}"
    for role in ("pickup", "dropoff")
    for c in ("location_id", "borough", "zone", "service_zone")
)

QUERIES = {
    "trip_volume": volume(),
    "trip_volume_month": volume("month"),
    "payment_analysis": payment(),
    "payment_analysis_years": payment("year(f.tpep_pickup_datetime) IN (1996, 1999)"),
    "hourly_activity": HOURLY,
    "passenger_analysis": PASSENGERS,
    "financial_breakdown": breakdown(),
    "financial_breakdown_quarter": breakdown("quarter"),
    "vendor_analysis": f"""
        SELECT coalesce(nullif(trim(vendor_name), ''), 'Vendor ' || vendor_key::text, 'Inconnu') AS vendor_name,
            trip_count, avg_total_amount, avg_trip_distance
        FROM (SELECT v.vendor_key, v.vendor_name, count(f.trip_id) AS trip_count,
                {mean("f.total_amount", "avg_total_amount")}, {mean("f.trip_distance", "avg_trip_distance")}
            FROM fact_trips f LEFT JOIN dim_vendor v ON f.vendor_key = v.vendor_key
            GROUP BY v.vendor_key, v.vendor_name)""",
    "rate_code_analysis": f"""
        SELECT coalesce(r.rate_code_name, 'Inconnu') AS rate_code_name, trip_count,
            avg_total_amount, avg_trip_distance, avg_tip_amount
        FROM (SELECT rc.rate_code_name, count(f.trip_id) AS trip_count,
                {mean("f.total_amount", "avg_total_amount")}, {mean("f.trip_distance", "avg_trip_distance")},
                {mean("f.tip_amount", "avg_tip_amount")}
            FROM fact_trips f LEFT JOIN dim_rate_code rc ON f.rate_code_key = rc.rate_code_key
            GROUP BY rc.rate_code_name) r""",
    "trip_duration_stats": f"""
        SELECT {mean("s", "avg_duration_seconds")},
            coalesce(min(s), 0.0) AS min_duration_seconds, coalesce(max(s), 0.0) AS max_duration_seconds,
            coalesce(quantile_cont(s, 0.25), 0.0) AS p25_duration_seconds,
            coalesce(quantile_cont(s, 0.5), 0.0) AS p50_duration_seconds,
            coalesce(quantile_cont(s, 0.75), 0.0) AS p75_duration_seconds
        FROM (SELECT epoch(trip_duration) AS s FROM fact_trips) WHERE s > 0""",
    "fare_efficiency": """
        SELECT round(coalesce(avg(CASE WHEN trip_distance > 0 THEN fare_amount / trip_distance END), 0.0), 4)
                AS avg_fare_per_km,
            round(coalesce(avg(CASE WHEN epoch(trip_duration) > 0
                THEN fare_amount / (epoch(trip_duration) / 60e0) END), 0.0), 4) AS avg_fare_per_minute
        FROM fact_trips""",
    "kpi_trends": f"""
        SELECT {KPI_COLUMNS}
        FROM ({WINDOW_TOTALS}) t, (SELECT max(trip_count) AS busiest FROM ({WINDOW_MONTHS})) m""",
    "kpi_trends_empty": "SELECT " + ", ".join(
        f"0e0 AS {name}_{part}" for name in KPI_NAMES for part in ("current", "previous", "trend")
    ),
    "kpi_window_totals_empty": "SELECT date '2024-12-31' AS date, cast(0 AS bigint) AS trip_count, 0e0 AS avg_total_amount",
    "kpi_busiest_month_empty": """
        SELECT date '2024-12-01' AS date, cast(0 AS bigint) AS trip_count, 0e0 AS avg_total_amount,
            0e0 AS avg_tip_amount, 0e0 AS avg_trip_distance, 0e0 AS avg_trip_duration_seconds""",
    "kpi_window_totals": WINDOW_TOTALS,
    "kpi_busiest_month": f"""
        SELECT date, trip_count, avg_total_amount, avg_tip_amount, avg_trip_distance, avg_trip_duration_seconds
        FROM ({WINDOW_MONTHS}) ORDER BY trip_count DESC, date LIMIT 1""",
    "zone_activity": f"""
        SELECT l.location_id, l.zone, l.borough, count(f.trip_id) AS trip_count,
            {mean("f.total_amount", "avg_total_amount")}
        FROM fact_trips f LEFT JOIN dim_location l ON f.pickup_location_key = l.location_key
        GROUP BY l.location_id, l.zone, l.borough""",
    "borough_flows": FLOWS,
    "borough_flows_top": f"{ALL_FLOWS} LIMIT 10",
    "year_filter": f"SELECT * FROM ({volume()}) WHERE year(date) IN (1996, 1999)",
    "period_rollup_week": rollup("week"),
    "period_rollup_month": rollup("month"),
    "period_rollup_quarter": rollup("quarter"),
    "period_rollup_month_exact": volume("month"),
    "period_rollup_week_exact": volume("week"),
    "financial_breakdown_daily": breakdown("quarter"),
    "monthly_distribution": f"""
        SELECT cast(m.month AS int) AS month, coalesce(cast(floor(p.mean + 0.5) AS bigint), 0) AS avg_trips
        FROM range(1, 13) m(month) LEFT JOIN (
            SELECT month(date) AS month, sum(trip_count) / cast(count(*) AS double) AS mean FROM ({volume()}) GROUP BY 1
        ) p ON p.month = m.month""",
    "hourly_heatmap": HEATMAP,
    "hourly_heatmap_dense": HEATMAP_DENSE,
    "hourly_heatmap_vendor": HEATMAP_VENDOR,
    "trend_series": f"""
        WITH r AS ({rollup("month")})
        SELECT date, 'trip_count' AS metric, cast(trip_count AS double) AS value FROM r
        UNION ALL SELECT date, 'avg_total_amount', avg_total_amount FROM r""",
    "financial_series": f"""
        WITH b AS (SELECT * FROM ({breakdown()}) WHERE year(date) IN (1997, 2000))
        SELECT date, 'fare' AS component, avg_fare_amount AS amount FROM b
        UNION ALL SELECT date, 'tip', avg_tip_amount FROM b
        UNION ALL SELECT date, 'tolls', avg_tolls_amount FROM b
        UNION ALL SELECT date, 'mta_tax', avg_mta_tax FROM b
        UNION ALL SELECT date, 'improvement_surcharge', avg_improvement_surcharge FROM b
        UNION ALL SELECT date, 'extra', avg_extra FROM b""",
    "passenger_labels": f"""
        SELECT coalesce(cast(passenger_count AS varchar), 'Inconnu') AS passenger_label, trip_count
        FROM ({PASSENGERS})""",
    "paged_table": f"SELECT * FROM ({rollup('month')}) ORDER BY date DESC LIMIT 10 OFFSET 20",
    "flow_page": f"""
        SELECT * FROM ({ALL_FLOWS}) ORDER BY trip_count DESC, pickup_borough, dropoff_borough LIMIT 15 OFFSET 15""",
    "flow_page_after": f"""
        SELECT * FROM ({ALL_FLOWS}) ORDER BY trip_count DESC, pickup_borough, dropoff_borough LIMIT 15 OFFSET 15""",
    "flow_search": f"""
        SELECT * FROM ({ALL_FLOWS}) WHERE lower(pickup_borough) LIKE '%ri%' AND lower(dropoff_borough) LIKE '%as%'""",
    "dq_field_completeness": FIELD_PCT,
    "dq_scorecard": scorecard(VALIDITY),
    "dq_scorecard_raw": scorecard(RAW_VALIDITY),
    "dq_missing_values": MISSING,
    "dq_format_errors": FORMAT_ERRORS,
    "dq_outliers": OUTLIERS,
    "dq_outliers_tip": outliers("tip_amount"),
    "dq_duplicates": DUPLICATES,
    "dq_alerts": ALERTS,
    "dq_alert_page": f"SELECT * FROM ({ALERTS}) ORDER BY id LIMIT 2 OFFSET 2",
    "dim_date": """
        SELECT cast(strftime(d, '%Y%m%d') AS int) AS date_key, cast(d AS date) AS full_date,
            cast(year(d) AS int) AS year, cast(month(d) AS int) AS month, cast(day(d) AS int) AS day,
            cast(isodow(d) AS int) AS day_of_week, dayname(d) AS day_name, monthname(d) AS month_name,
            cast(quarter(d) AS int) AS quarter, isodow(d) >= 6 AS is_weekend
        FROM (SELECT unnest(generate_series(date_trunc('day', min(tpep_pickup_datetime)),
            date_trunc('day', max(tpep_pickup_datetime)), interval 1 day)) AS d FROM fact_trips)""",
    "trip_duration": """
        SELECT trip_id, cast(epoch(tpep_dropoff_datetime - tpep_pickup_datetime) AS double) AS trip_duration_seconds
        FROM fact_trips""",
    "trips_enriched": f"""
        SELECT f.* REPLACE (cast(epoch(f.trip_duration) AS double) AS trip_duration),
            {DAYS_IN_ROLES}, {PLACES_IN_ROLES},
            pt.* EXCLUDE (payment_type_key), rc.* EXCLUDE (rate_code_key), v.* EXCLUDE (vendor_key)
        FROM fact_trips f
        LEFT JOIN dim_date pickup_d ON f.pickup_date_key = pickup_d.date_key
        LEFT JOIN dim_date dropoff_d ON f.dropoff_date_key = dropoff_d.date_key
        LEFT JOIN dim_location pickup_l ON f.pickup_location_key = pickup_l.location_key
        LEFT JOIN dim_location dropoff_l ON f.dropoff_location_key = dropoff_l.location_key
        LEFT JOIN dim_payment_type pt ON f.payment_type_key = pt.payment_type_key
        LEFT JOIN dim_rate_code rc ON f.rate_code_key = rc.rate_code_key
        LEFT JOIN dim_vendor v ON f.vendor_key = v.vendor_key""",
    "kpi_period_trend": period_trend("month"),
    "kpi_period_trend_quarter": period_trend("quarter", "year(date) IN (1998, 2001)"),
}


def oracle_sql() -> dict[str, str]:
    return {name: f"{STAR}\nSELECT * FROM ({query}\n) AS report" for name, query in QUERIES.items()}
