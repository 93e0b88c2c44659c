"""Data-quality checks of the trip table."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions.keysets import holds, key_words
from farelens.operators.distribution import brackets, quantiles
from farelens.sources.schema import TripTables

# Fields, dimensions, targets, alert kinds and messages of the quality section.
COMPLETENESS_FIELDS = {
    "pickup_location": "pickup_location_key",
    "dropoff_location": "dropoff_location_key",
    "passenger_count": "passenger_count",
    "trip_distance": "trip_distance",
    "fare_amount": "fare_amount",
    "tip_amount": "tip_amount",
    "total_amount": "total_amount",
}
TARGETS = {
    "Complétude": 99.0,
    "Validité": 98.0,
    "Unicité": 100.0,
    "Cohérence": 95.0,
    "Actualité": 95.0,
    "Précision": 95.0,
}
SEVERITIES = ("high", "medium", "low")
MISSING_VALUES = ("high", "missing_values", "passenger_count", "trajets sans comptage passagers")
FORMAT_ERROR = ("medium", "format_error", "pickup_datetime", "dates au format incorrect")
OUTLIER = ("low", "outlier", "fare_amount", "trajets avec tarifs anormalement élevés")
DUPLICATE = ("medium", "duplicate", "trip_id", "identifiants de trajet dupliqués")

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIMESTAMP_SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"
FRESH_DAYS = 30
FENCE_WIDTH = 1.5


def _percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def field_completeness(tables: TripTables) -> DataFrame:
    """``(field, pct)``: share of trips with each required field present, from one scan."""
    shares = tables.fact_trips.agg(
        *[_percent(F.count(c), F.count("*")).alias(field) for field, c in COMPLETENESS_FIELDS.items()]
    )
    return shares.unpivot([], list(COMPLETENESS_FIELDS), "field", "pct")


def missing_values(tables: TripTables, column: str = "passenger_count") -> DataFrame:
    """The trips without a value in ``column``."""
    return tables.fact_trips.where(F.col(column).isNull()).select("trip_id")


def format_errors(
    tables: TripTables,
    raw: DataFrame | None = None,
    column: str = "pickup_datetime",
    fmt: str = TIMESTAMP_FORMAT,
) -> DataFrame:
    """``(trip_id, raw_value)`` of raw timestamp texts that do not parse.

    Without ``raw`` texts (a frame with ``trip_id`` and ``column``) it is the trips that have lost
    their pickup time.
    """
    if raw is None:
        lost = tables.fact_trips.where(F.col("tpep_pickup_datetime").isNull())
        return lost.select("trip_id", F.lit(None).cast("string").alias("raw_value"))
    text = F.col(column)
    return raw.where(text.isNotNull() & ~_parses(text, fmt)).select("trip_id", text.alias("raw_value"))


def _parses(text: Column, fmt: str) -> Column:
    if fmt == TIMESTAMP_FORMAT:
        # The same test as below for this one format, at a tenth of its cost.
        return text.rlike(TIMESTAMP_SHAPE) & text.try_cast("timestamp_ntz").isNotNull()
    return F.try_to_timestamp(text, F.lit(fmt)).isNotNull()


FENCE_QUARTILES = (0.25, 0.75)


def fence(found: Column) -> Column:
    """A record ``{lower, upper}``: an array of both quartiles widened by 1.5 interquartile ranges."""
    reach = (found[1] - found[0]) * FENCE_WIDTH
    return F.struct((found[0] - reach).alias("lower"), (found[1] + reach).alias("upper"))


def _fence_of(amounts: DataFrame, cuts: Column) -> Column:
    """The fence of a column with these :func:`brackets`."""
    present = amounts.toDF("value").where(F.col("value").isNotNull())
    found = quantiles(present, cuts, FENCE_QUARTILES)
    return found.select(fence(F.col("quantiles")).alias("bounds")).scalar()


def _one_record(row: DataFrame) -> Column:
    """A table of one row as one record. All who use it use the same query, which Spark then runs once."""
    return row.select(F.struct("*")).scalar()


def outliers(tables: TripTables, column: str = "fare_amount") -> DataFrame:
    """``(trip_id, <column>)`` of trips whose amount lies above the upper fence."""
    amount = F.col(column)
    cuts = tables.fact_trips.agg(brackets(amount, FENCE_QUARTILES)).scalar()
    bounds = _fence_of(tables.fact_trips.select(amount.cast("double")), cuts)
    return tables.fact_trips.where(amount > bounds["upper"]).select("trip_id", column)


def duplicates(tables: TripTables) -> DataFrame:
    """``(trip_id, occurrences)`` of ids that occur more than once."""
    return _occurrences(tables).where(F.col("occurrences") > 1)


def _occurrences(tables: TripTables) -> DataFrame:
    ids = tables.fact_trips if tables.trip_ids is None else tables.trip_ids
    return ids.groupBy("trip_id").agg(F.count("*").alias("occurrences"))


def scorecard(
    tables: TripTables,
    as_of: Column | None = None,
    raw: DataFrame | None = None,
    column: str = "pickup_datetime",
    fmt: str = TIMESTAMP_FORMAT,
) -> DataFrame:
    """``(dimension, score, target)``: six quality scores in percent.

    Timeliness looks back 30 days from ``as_of`` (default: the latest pickup). Validity is the share of
    ``raw`` texts that parse, all others being :func:`format_errors`; without ``raw`` it is the share of
    trips with both times.
    """
    fact = tables.fact_trips
    pickup, dropoff, fare = F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime"), F.col("fare_amount")
    # First scan: what needs no other figure, and what the second and third need.
    complete = [_percent(F.count(c), F.count("*")) for c in COMPLETENESS_FIELDS.values()]
    first = _one_record(
        fact.agg(
            (reduce(add, complete) / F.lit(len(complete))).alias("complete"),
            _percent(F.count_if(pickup.isNotNull() & dropoff.isNotNull()), F.count("*")).alias("timed"),
            F.max(pickup).alias("latest"),
            brackets(fare, FENCE_QUARTILES).alias("cuts"),
        )
    )
    # Second scan, for the fence; third: each trip against the fence, the last 30 days and all key lists.
    fence_bounds = _fence_of(fact.select("fare_amount"), first["cuts"])
    until = first["latest"] if as_of is None else as_of.cast("timestamp_ntz")
    fresh = pickup.between(F.col("until") - F.expr(f"INTERVAL '{FRESH_DAYS}' DAY"), F.col("until"))
    bounds, lists = F.col("bounds"), _key_lists(tables)
    words = {name: listed for name, (listed, _) in lists.items()}
    measured = fact.withColumns({"bounds": fence_bounds, "until": until, **words})
    per_vendor = measured.groupBy("vendor_key").agg(
        F.count("*").alias("trips"),
        F.count_if(_sound(lists)).alias("sound"),
        F.count_if(fresh).alias("fresh"),
        F.count(pickup).alias("dated"),
        F.count_if(fare.between(bounds["lower"], bounds["upper"])).alias("inside"),
        F.count(fare).alias("priced"),
    )
    checked = _known_vendors(per_vendor, tables).agg(
        _percent(F.sum(F.when(F.col("known"), F.col("sound")).otherwise(0)), F.sum("trips")).alias("Cohérence"),
        _percent(F.sum("fresh"), F.sum("dated")).alias("Actualité"),
        _percent(F.sum("inside"), F.sum("priced")).alias("Précision"),
    )
    one_row = checked.withColumn("first", first).select(
        *checked.columns, F.col("first.complete").alias("Complétude"), F.col("first.timed").alias("Validité")
    )
    if raw is not None:
        one_row = one_row.drop("Validité")
    scores = one_row.unpivot([], one_row.columns, "dimension", "score")
    # Ids are counted apart, and raw texts are another table.
    own_scans = {
        "Unicité": _occurrences(tables).agg(
            _percent(F.count("trip_id"), F.sum("occurrences")).alias("score")
        )
    }
    if raw is not None:
        text = F.col(column)
        own_scans["Validité"] = raw.agg(_percent(F.count_if(_parses(text, fmt)), F.count(text)).alias("score"))
    for name, score in own_scans.items():
        scores = scores.unionByName(score.select(F.lit(name).alias("dimension"), "score"))
    targets = F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])
    order = F.array_position(F.array(*[F.lit(name) for name in TARGETS]), F.col("dimension"))
    return scores.select("dimension", "score", targets[F.col("dimension")].alias("target")).orderBy(order)


def _key_lists(tables: TripTables) -> dict[str, tuple[Column, tuple[str, ...]]]:
    """For each list of days, zones and codes its keys as one array of bits, and the trip columns that refer to it.

    These lists have dense keys (see ``farelens.functions.keysets``), so no trip has to be joined.
    """
    lists = {
        "days": (tables.dim_date, "date_key", ("pickup_date_key", "dropoff_date_key")),
        "zones": (tables.dim_location, "location_key", ("pickup_location_key", "dropoff_location_key")),
        "rates": (tables.dim_rate_code, "rate_code_key", ("rate_code_key",)),
        "payments": (tables.dim_payment_type, "payment_type_key", ("payment_type_key",)),
    }
    return {
        name: (_one_record(key_words(dimension, key)), columns)
        for name, (dimension, key, columns) in lists.items()
    }


def _sound(lists: dict[str, tuple[Column, tuple[str, ...]]]) -> Column:
    """Whether a trip ends no earlier than it starts and its days, zones and codes all exist; the lists are columns."""
    sound = F.coalesce(F.col("tpep_dropoff_datetime") >= F.col("tpep_pickup_datetime"), F.lit(False))
    for name, (_, columns) in lists.items():
        for column in columns:
            sound = sound & (F.col(column).isNull() | holds(F.col(name), F.col(column)))
    return sound


def _known_vendors(per_vendor: DataFrame, tables: TripTables) -> DataFrame:
    """Counts per vendor key, with ``known``: whether the vendor exists. The list of vendors is the one
    dimension that grows with the business, so it is joined, but only to one row per vendor."""
    listed = tables.dim_vendor.select(F.col("vendor_key").alias("listed_key")).distinct()
    joined = per_vendor.join(listed, F.col("vendor_key") == F.col("listed_key"), "left")
    return joined.withColumn("known", F.col("vendor_key").isNull() | F.col("listed_key").isNotNull())


def alerts(
    tables: TripTables,
    raw: DataFrame | None = None,
    column: str = "pickup_datetime",
    fmt: str = TIMESTAMP_FORMAT,
    as_of: Column | None = None,
) -> DataFrame:
    """``(id, severity, type, field, message, date)`` for each check that found something.

    Most severe first, then latest; ids follow that order. ``date`` is ``as_of`` (default: the
    latest pickup). The other arguments are those of :func:`format_errors`.
    """
    fact = tables.fact_trips
    kind, fare = MISSING_VALUES[2], F.col(OUTLIER[2])
    first = _one_record(
        fact.agg(
            F.count_if(F.col(kind).isNull()).alias("missing"),
            F.max("tpep_pickup_datetime").alias("latest"),
            brackets(fare, FENCE_QUARTILES).alias("cuts"),
        )
    )
    bounds = _fence_of(fact.select(fare), first["cuts"])
    date = (first["latest"] if as_of is None else as_of).cast("date")
    # Kinds whose figures come from the same scan are columns of one row until the last step.
    high = fact.withColumn("bounds", bounds).agg(F.count_if(fare > F.col("bounds.upper")).alias(OUTLIER[1]))
    one_row = high.withColumn(MISSING_VALUES[1], first["missing"])
    one_each = F.count("*").alias("n")
    counted = one_row.unpivot([], [OUTLIER[1], MISSING_VALUES[1]], "kind", "n")
    for (_, name, _, _), listed in (
        (FORMAT_ERROR, format_errors(tables, raw, column, fmt)),
        (DUPLICATE, duplicates(tables)),
    ):
        counted = counted.union(listed.agg(one_each).select(F.lit(name), "n"))
    kinds = F.create_map(
        *[
            x
            for severity, name, field, text in (MISSING_VALUES, FORMAT_ERROR, OUTLIER, DUPLICATE)
            for x in (
                F.lit(name),
                F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.lit(text).alias("text")),
            )
        ]
    )
    told = kinds[F.col("kind")]
    listed = counted.where(F.col("n") > 0).select(
        told["severity"].alias("severity"),
        F.col("kind").alias("type"),
        told["field"].alias("field"),
        F.concat_ws(" ", F.col("n").cast("string"), told["text"]).alias("message"),
        date.alias("date"),
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    by_rank = Window.orderBy(rank, F.desc("date"), "type")
    return listed.select(F.row_number().over(by_rank).alias("id"), "*").orderBy("id")
