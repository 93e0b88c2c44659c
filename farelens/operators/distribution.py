"""Exact quantiles in two scans and without sorting the data.

The first scan makes Spark's mergeable quantile sketch of the values, together with their number, sum and
extremes. It brackets each wanted quantile between two values. The second scan counts the values below, between and
above the brackets and keeps those inside, one row per distinct value: about ``4 / accuracy`` of
all values per quantile. Counting ranks from the counts leads to the exact result. Should a sketch ever have
missed a rank, the part of the values that holds it is read again; adaptive execution leaves that out otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions.measures import finished, mean_parts

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 10_000  # of the sketch: its error is 1/10,000 of the rows


def brackets(value: Column, fractions: Sequence[float] = QUARTILES, accuracy: int = ACCURACY) -> Column:
    """Aggregate: an array of a lower and an upper value around the quantile of each fraction.

    Twice the error of the sketch is left on both sides. NULL without any finite value.
    """
    reach = 2 / accuracy
    around = [min(max(p + side, 0.0), 1.0) for p in fractions for side in (-reach, reach)]
    finite = F.when(F.abs(value) < float("inf"), value)
    return F.percentile_approx(finite, around, accuracy)


def summary(values: DataFrame, fractions: Sequence[float] = QUARTILES, accuracy: int = ACCURACY) -> DataFrame:
    """One row ``(rows, mean, lowest, highest, cuts)`` of the doubles in the column ``value``."""
    value = F.col("value")
    figures = values.agg(
        F.count(value).alias("rows"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        brackets(value, fractions, accuracy).alias("cuts"),
        *mean_parts(["value"], stable=True),
    )
    total = finished(figures, ["value"], sums=True)
    return total.select("rows", (F.col("value") / F.col("rows")).alias("mean"), "lowest", "highest", "cuts")


def distribution(
    values: DataFrame, fractions: Sequence[float] = QUARTILES, accuracy: int = ACCURACY
) -> DataFrame:
    """One row ``(rows, mean, lowest, highest, quantiles)`` describing the doubles in the column ``value``.

    ``quantiles`` is an array in the order of ``fractions``; each is interpolated linearly between the two
    neighbouring values. NULLs are left out, NaN is the greatest value. Without values rows is 0 and the
    rest NULL. One task per wanted rank orders the distinct values in its bracket; a greater ``accuracy``
    keeps them few for very many rows, at the price of a larger sketch.
    """
    known = values.where(F.col("value").isNotNull()).select("value")
    # One record for both uses, so that both are the same query and it runs once.
    figures = summary(known, fractions, accuracy).select(F.struct("*")).scalar()
    whole = quantiles(known, figures["cuts"], fractions).withColumn("whole", figures)
    return whole.select(
        F.coalesce("whole.rows", F.lit(0)).alias("rows"), "whole.mean", "whole.lowest", "whole.highest", "quantiles"
    )


def quantiles(known: DataFrame, cuts: Column, fractions: Sequence[float]) -> DataFrame:
    """One row ``(quantiles)`` of the non-null doubles in the column ``value``.

    ``cuts`` are the :func:`brackets` of the same fractions.
    """
    each = range(len(fractions))
    # ``cuts`` is a query of its own, so it is named once and then only referred to. Cells follow the order of
    # values. Inside a bracket more have been entered than left.
    entered = " + ".join(f"int(coalesce(value >= cuts[{2 * i}], false))" for i in each)
    left = " + ".join(f"int(coalesce(value > cuts[{2 * i + 1}], false))" for i in each)
    placed = (
        known.withColumn("cuts", cuts)
        .selectExpr("value", f"{entered} AS entered", f"{left} AS left")
        .selectExpr("value", "entered + left AS cell", "entered > left AS inside")
    )
    counts = (
        placed.selectExpr("cell", "CASE WHEN inside THEN value END AS value")
        .groupBy("cell", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A row for each distinct value inside, and one for all values between two brackets.
    sides = [(i, p, side) for i, p in enumerate(fractions) for side in ("floor", "ceil")]
    wanted = ", ".join(f"struct({i} AS slot, bigint({side}({p!r}D * (rows - 1))) AS rank)" for i, p, side in sides)
    picked = (
        counts.selectExpr(
            "cell",
            "value",
            "n",
            "sum(n) OVER (ORDER BY cell, value) - n AS start",
            "sum(n) OVER () AS rows",
        )
        .selectExpr(
            "*", f"filter(array_distinct(array({wanted})), w -> w.rank >= start AND w.rank < start + n) AS ranks"
        )
        .where("size(ranks) > 0")
        .selectExpr("cell", "value", "rows", "start", "inline(ranks)")
    )
    # At most two rows per fraction from here on.
    missed = F.broadcast(picked.where("value IS NULL").selectExpr("cell AS of", "rows", "start", "slot", "rank"))
    again = (
        placed.join(missed, F.col("cell") == F.col("of"))
        .groupBy("slot", "rank", "rows", "start", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("*", "start + sum(n) OVER (PARTITION BY slot, rank ORDER BY value) AS up_to")
        .where("rank < up_to AND rank >= up_to - n")
    )
    columns = ["slot", "rows", "value"]
    ends = [
        F.expr(f"{end}(CASE WHEN slot = {i} THEN value END) AS {name}{i}")
        for i in each
        for name, end in (("low", "min"), ("high", "max"))
    ]
    picked = picked.where("value IS NOT NULL").select(*columns).union(again.select(*columns))
    between = ", ".join(_interpolated(i, p) for i, p in enumerate(fractions))
    return picked.agg(F.max("rows").alias("rows"), *ends).selectExpr(f"array({between}) AS quantiles")


def _interpolated(slot: int, fraction: float) -> str:
    low, high, position = f"low{slot}", f"high{slot}", f"({fraction!r}D * (rows - 1))"
    share = f"({position} - floor({position}))"
    infinite = f"abs({low}) = double('Infinity')"  # their difference from the next value is not a number
    between = f"IF({infinite}, (1 - {share}) * {low} + {share} * {high}, {low} + {share} * ({high} - {low}))"
    return f"IF({low} = {high}, {low}, {between})"
