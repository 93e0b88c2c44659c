"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a host if the share of the host's pages that contain it is above a ratio.
Lines are counted by fingerprint (96 bits: xxHash64 and Murmur3), once a page, with map-side
aggregation; texts are never shuffled to count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import BLANKS, stored

MAX_RATIO = 0.1
MIN_PAGES = 3
SALTS = 16
OWN = "_line_"


def _print(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.hash(trimmed).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def boilerplate(
    docs: DataFrame,
    *,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(host, prints): the fingerprints of the lines that more than ``max_ratio`` of a host's pages have.

    A host has at most (mean lines a page) / ``max_ratio`` of them, so the arrays are bounded.
    """
    prints = F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), _has_words), _print))
    # Page totals ride along as a line that every page has once and no real line can be (NULL).
    every_page = F.array(F.lit(None).cast("struct<a:bigint,b:int>"))
    counted = (
        docs.select(
            F.col(host_col).cast("string").alias("host"),
            F.explode(F.concat(every_page, prints)).alias("print"),
        )
        .groupBy("host", "print")
        .agg(F.count(F.lit(1)).alias("pages"))
    )
    counted = stored(counted.where((F.col("pages") >= min_pages) | F.col("print").isNull()))
    totals = counted.where(F.col("print").isNull()).select(F.col("host").alias("h"), F.col("pages").alias("total"))
    return stored(
        counted.where(F.col("print").isNotNull())
        .join(totals, F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("pages") > F.lit(float(max_ratio)) * F.col("total"))
        .groupBy("host")
        .agg(F.collect_list("print").alias("prints"))
    )


def drop_boilerplate(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with its boilerplate lines gone, plus n_lines and n_dropped (lines with a word).

    Blank lines stay. A NULL text stays NULL, a NULL host is a host of its own, a text of boilerplate
    only becomes empty, repeated rows count as pages of their own, an empty table gives an empty one.
    Columns of ``docs`` named n_lines or n_dropped are replaced, all others are kept.
    """
    found = boilerplate(docs, host_col=host_col, text_col=text_col, **limits)
    # The hot host is spread over salts: its short list is repeated, its pages are not.
    spread = found.withColumn(OWN + "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
        F.col("host").alias(OWN + "host"), OWN + "salt", F.col("prints").alias(OWN + "prints")
    )
    salted = docs.withColumn(OWN + "own", F.pmod(F.xxhash64(F.col(text_col)), F.lit(SALTS)).cast("int"))
    joined = salted.join(
        spread,
        F.col(host_col).cast("string").eqNullSafe(F.col(OWN + "host")) & (F.col(OWN + "own") == F.col(OWN + "salt")),
        "left",
    )
    lines = _lines(F.col(text_col))
    kept = F.filter(
        lines,
        lambda line: ~_has_words(line)
        | F.col(OWN + "prints").isNull()
        | ~F.array_contains(F.col(OWN + "prints"), _print(line)),
    )
    kept_lines = F.col(OWN + "kept")
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.filter(lines, _has_words)))
    n_left = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.filter(kept_lines, _has_words)))
    text = F.when(F.col(text_col).isNotNull(), F.array_join(kept_lines, "\n"))
    return (
        joined.withColumn(OWN + "kept", kept)
        .select(
            *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
            n_lines.cast("long").alias("n_lines"),
            (n_lines - n_left).cast("long").alias("n_dropped"),
        )
    )
