"""Sets of keys as bits."""

import pytest
from pyspark.sql import functions as F

from farelens.functions.keysets import holds, key_words

PROBES = [None, -130, -129, -65, -64, -63, -1, 0, 1, 63, 64, 65, 127, 128, 20010101, 20011231, 2**40]


@pytest.mark.parametrize(
    "keys", [[], [None], [0], [63, 64, 64, None], [-130, -64, -1, 0, 128], [20010101 + d for d in range(0, 1200, 7)], [2**40, 2**40 - 500]]
)
def test_holds_exactly_its_keys(spark, keys):
    listed = spark.createDataFrame([(k,) for k in keys], "k long")
    probes = spark.createDataFrame([(p,) for p in [*PROBES, *keys]], "p long")
    words = key_words(listed, "k").select(F.struct("*")).scalar()
    got = probes.withColumn("set", words).select("p", holds(F.col("set"), F.col("p")).alias("held")).collect()
    assert all(r["held"] == (r["p"] is not None and r["p"] in keys) for r in got)
