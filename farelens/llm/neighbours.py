"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search in it.

NN-descent: every vector starts with the vectors beside it in the order of a few random projections
(taken inside range partitions, so nothing is sorted in one task). Then, round by round, the
neighbours of each vector, forward and a bounded number of backward ones, are introduced to each
other: groups of vectors near the same centre meet in a cell, one Spark join brings the vectors to
the cells that ask for them, one aggregation keeps the nearest for each.

Search: each query holds a pool of its best vectors so far. Every round, the pool's members that were
not yet expanded are joined with the graph, what is new is measured and the pool cut again, until no
query has anything left to expand.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.llm.common import stored

NEIGHBOURS = 20  # kept in the graph for each vector
BACKWARD = 20  # backward neighbours introduced in a round, drawn by a hash
INTRODUCED = 8  # nearest others that an introduction reports to each vector
PROJECTIONS = 4
ROUNDS = 5
POOL = 120
MEETING_ROWS = 1_000  # vectors whose groups meet in one task
MOST_CENTRES = 1_024
CELL_ROWS = 2_000  # about so many vectors share a cell of a random projection and are sorted together


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec): rows with an id and a vector that is not null, empty or zero and is finite throughout."""
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
        .where("id IS NOT NULL AND vec IS NOT NULL")
        .where(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
    )


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """(node, id, vec): the k + 1 smallest different ids of each different vector, node being the smallest.

    More copies of a vector can never be among the k nearest, so a vector that a third of the rows
    share is one node; Spark cuts the ranked rows before it shuffles them.
    """
    by_id = Window.partitionBy("vec").orderBy("id")
    first = rows.distinct().withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).drop("place")
    return first.withColumn("node", F.min("id").over(Window.partitionBy("vec")))


def _direction(seed: int, dims: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(dims)


def _first_graph(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, other): for each vector the ones next to it along random projections."""
    parts = []
    cells = max(1, vectors.count() // CELL_ROWS)
    half = max(1, NEIGHBOURS // 2 // PROJECTIONS)
    for seed in range(PROJECTIONS):
        direction = F.array(*[F.lit(float(x)) for x in _direction(seed, dims)])
        along = F.aggregate(F.zip_with("vec", direction, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        # Cells of equal width along the projection keep the windows local and parallel.
        placed = vectors.select("id", along.alias("p")).withColumn("cell", F.floor(F.atan("p") / math.pi * cells))
        order = Window.partitionBy("cell").orderBy("p", "id")
        for step in range(1, half + 1):
            parts.append(placed.select("id", F.lead("id", step).over(order).alias("other")).where("other IS NOT NULL"))
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.union(part)
    return edges.union(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id. edges: (id, other, dist), already distinct enough to be bounded per id."""
    best = Window.partitionBy("id").orderBy("dist", "other")
    return edges.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def _cells(vectors: DataFrame) -> DataFrame:
    """(id, cell): vectors near the same drawn centre share a cell; a crowded one is dealt out by a hash of the id."""
    wanted = max(1, min(vectors.count() // MEETING_ROWS, MOST_CENTRES))
    drawn = vectors.orderBy(F.xxhash64("id", F.lit("centre")), "id").limit(wanted).collect()
    centres = np.array([row["vec"] for row in drawn])
    sizes = (centres * centres).sum(axis=1)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                at = (sizes - 2.0 * (np.stack(pdf["vec"]) @ centres.T)).argmin(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "centre": at})

    near = stored(vectors.select("id", "vec").mapInPandas(run, "id long, centre long"))
    parts = near.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEETING_ROWS).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    return stored(near.join(parts, "centre").select("id", F.xxhash64("centre", part).alias("cell")))


def _introduce(groups: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The groups (id, other) of a cell: for every member its nearest other members, at most ``NEIGHBOURS`` of all groups."""
    known = known.sort_values("name")
    names, vecs = known["name"].to_numpy(), np.stack(known["vec"])
    groups = groups.sort_values(["id", "other"])
    place = np.searchsorted(names, groups["other"].to_numpy())
    starts = np.flatnonzero(np.diff(groups["id"].to_numpy())) + 1
    ids, others, dists = [], [], []
    for members in np.split(place, starts):
        if len(members) < 2:
            continue
        x = vecs[members]
        sq = (x * x).sum(axis=1)
        d = sq[:, None] + sq[None, :] - 2.0 * (x @ x.T)
        np.fill_diagonal(d, np.inf)
        k = min(INTRODUCED, len(members) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        ids.append(np.repeat(members, k))
        others.append(members[near].ravel())
        dists.append(np.take_along_axis(d, near, axis=1).ravel())
    if not ids:
        return pd.DataFrame({"id": [], "other": [], "dist": []})
    a, b, dist = np.concatenate(ids), np.concatenate(others), np.concatenate(dists)
    _, first = np.unique(a * len(names) + b, return_index=True)
    a, b, dist = a[first], b[first], dist[first]
    order = np.lexsort((b, dist, a))
    a, b, dist = a[order], b[order], dist[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < NEIGHBOURS
    return pd.DataFrame({"id": names[a[kept]], "other": names[b[kept]], "dist": dist[kept]})


def _round(graph: DataFrame, vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """One round of NN-descent. graph: (id, other). A vector goes once to each cell that asks for it, not to each group."""
    draw = Window.partitionBy("id").orderBy(F.xxhash64("id", "other"))
    backward = (
        graph.select(F.col("other").alias("id"), F.col("id").alias("other"))
        .withColumn("place", F.row_number().over(draw))
        .where(F.col("place") <= BACKWARD)
        .drop("place")
    )
    own = vectors.select("id", F.col("id").alias("other"))
    around = stored(graph.select("id", "other").union(backward).union(own).distinct().join(cells, "id"))
    asked = around.select(F.col("cell").alias("at"), F.col("other").alias("name")).distinct()
    known = asked.join(vectors.select(F.col("id").alias("name"), "vec"), "name")
    met = around.groupBy("cell").cogroup(known.groupBy("at")).applyInPandas(_introduce, "id long, other long, dist double")
    return _nearest(met.groupBy("id", "other").agg(F.min("dist").alias("dist")), NEIGHBOURS)


def build_graph(vectors: DataFrame, dims: int, rounds: int = ROUNDS) -> DataFrame:
    """(id, other): the neighbour graph of ``vectors`` (id, vec)."""
    graph = stored(_first_graph(vectors, dims))
    cells = _cells(vectors)
    for _ in range(rounds):
        graph = stored(_round(graph, vectors, cells).select("id", "other"))
    return graph


def _distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, itself left out.

    ``nodes`` is (node, id, vec). Queries (id, vec) that are a node's vector start from it, all start
    from a fixed spread of entry points too (nodes drawn by hash, at most ``POOL``).
    """
    vectors = nodes.where("node = id").select("id", "vec")
    links = stored(graph.union(graph.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    drawn = vectors.select("id", "vec").orderBy(F.xxhash64("id", F.lit("entry")), "id").limit(POOL)
    entries = stored(drawn.select(F.col("id").alias("other"), F.col("vec").alias("v")))
    names = F.array(*[F.lit(row["other"]) for row in entries.select("other").collect()])
    probe = queries.select(F.col("id").alias("query_id"), "vec")
    # Every query meets every entry point: these few rows go to the queries, not the queries to them.
    first = probe.withColumn("other", F.explode(names)).join(F.broadcast(entries), "other")
    own = probe.join(vectors.select("vec", F.col("id").alias("other")), "vec")
    columns = ["query_id", F.col("other").alias("vec_id"), _distance(F.col("vec"), F.col("v")).alias("score")]
    started = first.select(*columns).union(own.select("query_id", F.col("other").alias("vec_id"), F.lit(0.0).alias("score")))
    candidates = pool = None
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # Pools only get better, so what fell out of one never comes back, and this ends.
    while True:
        if candidates is None:
            measured = started.distinct()
        else:
            met = candidates.join(vectors.select(F.col("id").alias("other"), F.col("vec").alias("v")), "other")
            measured = met.join(probe, "query_id").select(*columns)
        measured = measured.withColumn("expanded", F.lit(False))
        if pool is not None:
            known = pool.select("query_id", "vec_id")
            measured = pool.withColumn("expanded", F.lit(True)).unionByName(
                measured.join(known, ["query_id", "vec_id"], "left_anti")
            )
        pool = stored(
            measured.withColumn("place", F.row_number().over(best)).where(F.col("place") <= POOL).drop("place")
        )
        fresh = pool.where("NOT expanded")
        if fresh.isEmpty():
            break
        candidates = (
            fresh.select("query_id", F.col("vec_id").alias("id")).join(links, "id").select("query_id", "other").distinct()
        )
    nearest = pool.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    rows = nearest.select("query_id", F.col("vec_id").alias("node"), "score").join(nodes.select("node", "id"), "node")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        rows.where("id != query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")
    )


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10
) -> DataFrame:
    """The k nearest rows of ``vectors`` found for each row of ``queries`` (both with id_col, vector_col).

    Distances are Euclidean, in double precision. Rows that are not ``usable`` take no part; a query
    with fewer than k candidates gets all that are found; ties go to the smaller id; repeated rows count
    once; empty tables give an empty result; other columns are ignored. Vectors and queries of another length
    than most vectors have take no part (where two lengths are as frequent, the shorter one counts).
    """
    sound = usable(vectors, id_col, vector_col)
    lengths = sound.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), "size").first()
    same = F.size("vec") == F.lit(usual["size"] if usual else 0)
    nodes = stored(_nodes(sound.where(same), k))
    asked = stored(usable(queries, id_col, vector_col).where(same).dropDuplicates(["id"]))
    first = nodes.first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vecs = nodes.where("node = id").select("id", "vec")
    return search(asked, nodes, build_graph(vecs, len(first["vec"])), k)
