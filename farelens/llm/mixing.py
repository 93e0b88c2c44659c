"""Mix sources to target weights by weighted fair queueing.

Every document waits in the queue of its source in a shuffled but fixed order (the MD5 of its id).
A copy of a document finishes at (tokens of its source up to and including it) / (target of the
source), so that at time t each source has handed out the fraction t of its target. All copies are
put in one global order of finish times and taken until the budget is used up.

Nothing is sorted in one task: running totals are taken inside buckets of the MD5 and shifted by the
totals of the buckets before; the cut is found from a histogram of finish times, then exactly inside
the one bin that holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.llm.common import stored, word_count

BUCKET_DIGITS = 3  # hexadecimal digits of the MD5: 4,096 buckets a source
BINS_PER_TARGET = 65_536
LAST_BIN = 4 * BINS_PER_TARGET
OWN = "_mix_"


@dataclass(frozen=True)
class MixPlan:
    """Bucket offsets and targets, and the last copy taken as (finish, source rank, key, id, epoch)."""

    buckets: DataFrame
    cut: tuple | None
    epochs: int


def _queued(docs: DataFrame, id_col: str, source_col: str, size: Column, seed: str) -> DataFrame:
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed)))
    return docs.withColumns(
        {
            OWN + "id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))),
            OWN + "source": F.col(source_col).cast("string"),
            OWN + "size": size,
            OWN + "key": key,
        }
    ).withColumn(OWN + "bucket", F.substring(OWN + "key", 1, BUCKET_DIGITS))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """One row per source: (source, size, rank, weight, target).

    Sources are ranked by code point, NULL last, and weighted by ``cycle`` repeated. The budget is
    ``share`` of all tokens. A target stops at ``epochs`` times the source; the level that shares the
    rest by weight is found from the sources ordered by the level at which each is full.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1)
    limit = F.lit(epochs) * F.col("size")
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("weight", weight.cast("long"))
        .withColumn("full_at", limit / F.col("weight"))
        .withColumns(
            {
                "budget": F.sum("size").over(everything) * F.lit(float(share)),
                "full_before": F.coalesce(F.sum(limit).over(before), F.lit(0)),
                "weight_left": F.sum("weight").over(everything)
                - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            }
        )
        .withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_left"))
    )
    # Levels fall from the first source that is not full on, so the first such level is the largest.
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    target = F.when(F.col("full_at") <= F.col("water"), limit.cast("double")).otherwise(
        F.col("weight") * F.col("water")
    )
    return (
        filled.withColumn("water", F.coalesce(level, F.max("full_at").over(everything)))
        .withColumn("target", target)
        .select("source", "size", "rank", "weight", "target")
    )


def _offsets(queued: DataFrame, cycle, share, epochs) -> DataFrame:
    per_bucket = stored(
        queued.groupBy(F.col(OWN + "source").alias("source"), F.col(OWN + "bucket").alias("bucket")).agg(
            F.sum(OWN + "size").alias("bucket_size")
        )
    )
    sizes = per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("size"))
    targets = source_targets(sizes, cycle, share, epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("bucket_size").over(before), F.lit(0))
    shifted = per_bucket.withColumn("offset", offset)
    joined = shifted.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    return stored(joined.select("b.source", "bucket", "offset", "rank", "size", "target"))


def _finish_times(queued: DataFrame, plan: MixPlan) -> DataFrame:
    """Adds rank, source size, target and the place of each document in the queue of its source."""
    own = plan.buckets.select(
        F.col("source").alias(OWN + "s"),
        F.col("bucket").alias(OWN + "b"),
        F.col("offset").alias(OWN + "offset"),
        F.col("rank").alias(OWN + "rank"),
        F.col("size").alias(OWN + "source_size"),
        F.col("target").alias(OWN + "target"),
    )
    in_bucket = (
        Window.partitionBy(OWN + "source", OWN + "bucket")
        .orderBy(OWN + "key", OWN + "id", OWN + "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = queued.withColumn(OWN + "sum", F.sum(OWN + "size").over(in_bucket))
    same = F.col(OWN + "source").eqNullSafe(F.col(OWN + "s")) & (F.col(OWN + "bucket") == F.col(OWN + "b"))
    # Buckets grow with the table, so the join is the same at every size: both sides are shuffled.
    return running.join(own.hint("merge"), same).withColumn(OWN + "place", F.col(OWN + "offset") + F.col(OWN + "sum"))


def _finish(epoch: Column) -> Column:
    return (epoch * F.col(OWN + "source_size") + F.col(OWN + "place")) / F.col(OWN + "target")


def _find_cut(timed: DataFrame, budget: float, epochs: int) -> tuple | None:
    copies = (
        timed.where(F.col(OWN + "size") > 0)
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
        .select(
            _finish(F.col("epoch")).alias("finish"),
            F.col(OWN + "rank").alias("rank"),
            F.col(OWN + "key").alias("key"),
            F.col(OWN + "id").alias("id"),
            "epoch",
            F.col(OWN + "size").alias("size"),
        )
        .withColumn("bin", F.least(F.floor(F.col("finish") * BINS_PER_TARGET), F.lit(LAST_BIN)))
    )
    up_to = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = copies.groupBy("bin").agg(F.sum("size").alias("size")).withColumn("up_to", F.sum("size").over(up_to))
    bins = stored(bins.select("bin", "size", "up_to"))
    over = bins.where(F.col("up_to") > budget).orderBy("bin").first()
    if over is None:
        return (float("inf"), 0, "", 0, 0)
    order = ("finish", "rank", "key", "id", "epoch")
    in_bin = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        copies.where(F.col("bin") == over["bin"])
        .withColumn("up_to", F.sum("size").over(in_bin) + F.lit(over["up_to"] - over["size"]))
        .where(F.col("up_to") <= budget)
        .select(F.max(F.struct(*order)).alias("last"))
        .first()["last"]
    )
    if taken is not None:
        return tuple(taken)
    # Nothing of that bin fits: cut just before it.
    return (over["bin"] / BINS_PER_TARGET, 0, "", 0, 0)


def plan_mix(
    docs: DataFrame,
    *,
    cycle: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    epochs: int = 3,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    seed: str = "mix",
) -> tuple[DataFrame, MixPlan]:
    """The narrow queue table of ``docs`` with its finish times, and the plan that cuts it."""
    own_size = word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    queued = stored(
        _queued(docs.select(*dict.fromkeys([id_col, source_col, "text"])), id_col, source_col, own_size, seed).select(
            F.col(id_col), *[OWN + c for c in ("id", "source", "size", "key", "bucket")]
        )
    )
    buckets = _offsets(queued, cycle, share, epochs)
    timed = _finish_times(queued, MixPlan(buckets, None, epochs))
    total = queued.agg(F.sum(OWN + "size")).first()[0] or 0
    return timed, MixPlan(buckets, _find_cut(timed, total * share, epochs), epochs)


def _copies(plan: MixPlan) -> Column:
    names = ("rank", "key", "id")
    kinds = ("double", "int", "string", "long", "int")

    def taken(epoch: int) -> Column:
        fields = [_finish(F.lit(epoch)), *[F.col(OWN + n) for n in names], F.lit(epoch)]
        mine = F.struct(*[c.cast(k).alias(str(i)) for i, (c, k) in enumerate(zip(fields, kinds))])
        limit = F.struct(*[F.lit(v).cast(k).alias(str(i)) for i, (v, k) in enumerate(zip(plan.cut, kinds))])
        return F.when((F.col(OWN + "size") > 0) & (mine <= limit), 1).otherwise(0)

    total = taken(0)
    for epoch in range(1, plan.epochs):
        total = total + taken(epoch)
    return total


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken (= copies * size).

    Sizes are words. NULL and blank texts have size 0 and are never taken; a NULL source is a source
    of its own, a NULL id sorts first, rows that are equal in id, source and size are interchangeable.
    An empty table gives an empty result. Other columns of ``docs`` are ignored. See ``plan_mix`` for
    the options. Sources are a recipe's list: their number is assumed to fit one task, documents are not.
    """
    timed, plan = plan_mix(docs, **options)
    id_col = options.get("id_col", "doc_id")
    return timed.select(
        F.col(id_col),
        F.col(OWN + "size").alias("size"),
        F.col(OWN + "source_size").alias("source_size"),
        F.col(OWN + "target").alias("target"),
        _copies(plan).cast("int").alias("copies"),
        (_copies(plan) * F.col(OWN + "size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, with its own columns."""
    _, plan = plan_mix(docs, **options)
    size = options.get("size")
    own_size = word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    queued = _queued(
        docs, options.get("id_col", "doc_id"), options.get("source_col", "source"), own_size, options.get("seed", "mix")
    )
    repeated = _finish_times(queued, plan).withColumn(OWN + "copies", _copies(plan))
    return repeated.withColumn(
        OWN + "copy", F.explode(F.array_repeat(F.lit(1), F.col(OWN + "copies").cast("int")))
    ).select(*docs.columns)
