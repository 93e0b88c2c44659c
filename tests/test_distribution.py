"""Exact quantiles against Spark's own percentile, whatever the values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from farelens.operators.distribution import distribution, quantiles

INF, NAN = math.inf, math.nan
rng = random.Random(5)
CASES = {
    "nan": [1.0, 2.0, 3.0, NAN],
    "infinite": [1.0, 2.0, 3.0, INF, INF],
    "both_ends": [-INF, -INF, -1.0, 0.0, INF, NAN],
    "large": [1e19, 1.0, -1e300, 1e300, 5e-324, -5e-324, 0.0],
    "within_one": [rng.random() for _ in range(500)],
    "neighbours": [math.nextafter(8.0, k) for k in (0.0, 9.0)] + [8.0, math.nextafter(2.0**900, 0.0), 2.0**900],
    "repeated": [7.25] * 40,
    "mixed": [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(400)],
}


@pytest.mark.parametrize("name", CASES)
def test_quantiles_equal_those_of_spark(spark, name):
    values = spark.createDataFrame([(v,) for v in CASES[name]] + [(None,)], "v double")
    own = distribution(values.toDF("value"), (0.0, 0.25, 0.5, 0.75, 1.0)).first()
    theirs = values.agg(F.percentile("v", [0.0, 0.25, 0.5, 0.75, 1.0]), F.min("v"), F.max("v")).first()
    assert own["rows"] == len(CASES[name])
    for a, b in zip([*own["quantiles"], own["lowest"], own["highest"]], [*theirs[0], theirs[1], theirs[2]]):
        # Halfway between 0 and the smallest double both are equally near, so either may come out.
        assert (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=5e-324)


def test_an_empty_histogram_has_no_rows(spark):
    row = distribution(spark.createDataFrame([], "value double")).first()
    assert row["rows"] == 0 and row["mean"] is None and row["quantiles"] == [None] * 3


@pytest.mark.parametrize("cuts", [[1e9] * 6, [-1e9] * 6, [1.0, 1.0, 0.5, 2.0, 30.0, 90.0], None])
def test_a_rank_outside_its_bracket_is_found_all_the_same(spark, cuts):
    values = [float(i % 60) for i in range(400)] + [INF]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    wrong = F.lit(cuts).cast("array<double>") if cuts else F.lit(None).cast("array<double>")
    got = quantiles(df, wrong, (0.25, 0.5, 0.75)).first()["quantiles"]
    assert got == df.agg(F.percentile("value", [0.25, 0.5, 0.75])).first()[0]
