"""Connected components of a link table by alternating large-star and small-star steps; pivots of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where(F.col("v") > F.col("u")).join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link, root being the smallest node it reaches.

    ``links`` has long columns u and v in any order; loops, NULLs and repeated links are ignored. Each
    step shuffles links on a node with map-side aggregation and is stored, so a node with very many
    links is only a skewed join side, which adaptive execution splits.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    edges = stored(ordered.distinct())
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges)))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


MOST_PIVOTS = 256  # of a bucket in one round


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (key, id and more) in buckets that hold more than one component, with their present
    root and ``big``, the component that has most members of the bucket."""
    placed = (
        members.drop("root", "big")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    counts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        counts.groupBy("key")
        .agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max(F.struct("n", "root"))["root"].alias("big"))
        .where("a != b")
    )
    return placed.join(mixed.select("key", "big"), "key")


def pivots(members: DataFrame, attempt: int, order: list[str]) -> DataFrame:
    """The next pivots of each bucket: one in the first round, twice as many in each later one.

    Members of a bucket's largest component come last: once the others have all been pivots, only one
    component is left. Buckets draw independently. Spark cuts the ranked rows before it shuffles them.
    """
    if attempt == 0:
        first = Window.partitionBy("key").orderBy("id", *order)
    else:
        first = Window.partitionBy("key").orderBy(F.col("root") == F.col("big"), F.xxhash64("key", "id"), "id", *order)
    ranked = members.withColumn("place", F.row_number().over(first))
    return ranked.where(F.col("place") <= min(2**attempt, MOST_PIVOTS)).drop("place")
