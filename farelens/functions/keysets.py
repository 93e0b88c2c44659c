"""Exact sets of whole-number keys as arrays of bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def key_words(rows: DataFrame, key: str) -> DataFrame:
    """One row ``(first, words)``: the distinct non-null values of a column of whole numbers.

    ``words`` are 64-bit words from the one that holds the least key (number ``first``) to the one that holds the
    greatest, so the set takes an eighth of a byte per number between them: 130 KB for the days of a century
    as yyyymmdd, and little for codes. It is for lists with dense keys.
    """
    value = F.col(key).cast("long")
    number = F.floor(value / BITS).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(value, F.lit(BITS)).cast("int"))
    words = (
        rows.where(value.isNotNull())
        .groupBy(number.alias("number"))
        .agg(F.bit_or(bit).alias("word"))
        .agg(F.min("number").alias("first"), F.max("number").alias("last"), F.collect_list(F.struct("number", "word")).alias("set"))
    )
    by_number = F.map_from_entries("set")
    dense = F.transform(
        F.sequence("first", "last"), lambda n: F.coalesce(F.try_element_at(by_number, n), F.lit(0).cast("long"))
    )
    none = F.array().cast("array<long>")
    # Without keys first is NULL, and no key is held.
    return words.select("first", F.when(F.col("first").isNotNull(), dense).otherwise(none).alias("words"))


def holds(listed: Column, key: Column) -> Column:
    """Whether a set, a record as :func:`key_words` gives, holds ``key``; NULL keys are not held."""
    value = key.cast("long")
    word = F.get(listed["words"], (F.floor(value / BITS) - listed["first"]).try_cast("int"))
    bit = F.getbit(word, F.pmod(value, F.lit(BITS)).cast("int"))
    return F.coalesce(bit == 1, F.lit(False))
