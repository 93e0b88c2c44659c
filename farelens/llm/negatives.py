"""Hard-negative mining with an inverted multi-index, exact.

Vectors are whole numbers and a score is their inner product. Each half of the dimensions has a codebook of
centres; the pair of nearest centres is a vector's cell, and every row is in the index.

- For an anchor, a half's score lies within (its length) * (radius) of its score with the centre, the radius
  being the largest distance of a member of the centre from it. The two half bounds add up to a bound of all
  scores in a cell, so the two lists of codes, each sorted by bound, give the cells by falling bound: a heap
  holds the next candidates (the multi-sequence order).
- A round visits each open anchor's next cells, joins them with the index and scores them by matrix products.
- A search is for the best rows inside windows of scores. A window is certified once it holds as many rows as
  wanted and the next cell's bound is below the last of these, or below the window, or no cell is left.
  Rounds go on until all windows of all anchors are certified, so results are those of comparing
  everything, whatever the codebooks; bad codebooks only cost time.

The first search finds each anchor's positives (one window, same label), the second its negatives (one
window for each positive, other labels). Equal vectors of one label stand in the index with their smallest ids
only, as many as any result could hold; cells are cut into blocks and anchors into chunks, so that one
task's pair of block and chunk is bounded whatever the skew.
"""

from __future__ import annotations

import heapq
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.llm.common import stored
from farelens.llm.whitening import as_matrix, whole_vectors

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # per cent of the positive's score
FIT_ROWS = 16_384  # rows with the smallest hashes, for the codebooks
FIT_STEPS = 12
CELL_ROWS = 512  # wanted in a cell
MOST_CODES = 1024  # of a half, so that what tasks are sent of an index is bounded
BLOCK_ROWS = 2_048  # of a cell that meet a chunk of anchors at once
CHUNK_ANCHORS = 1_024
FIRST_ROWS, ROWS_GROWTH = 4_096, 16  # rows visited for an anchor in the first round; more in each later one
EXACT = 2**53
NO_LIMIT = 2**62


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the number of its nearest centre and the distance to it."""
    square = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)
    code = square.argmin(axis=1)
    return code, np.sqrt(((points - centres[code]) ** 2).sum(axis=1))


def codebook(sample: np.ndarray, codes: int) -> np.ndarray:
    """Centres of ``sample`` by Lloyd's steps, from evenly spaced rows of it."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)].astype(float)
    for _ in range(FIT_STEPS):
        code, _ = _nearest(sample, centres)
        members = np.bincount(code, minlength=len(centres))
        for column in range(sample.shape[1]):
            total = np.bincount(code, weights=sample[:, column], minlength=len(centres))
            centres[:, column] = np.where(members > 0, total / np.maximum(members, 1), centres[:, column])
    return centres


class Cells:
    """What the search needs of an index: centres and radii of both halves, and rows per cell."""

    def __init__(self, centres: list[np.ndarray], radii: list[np.ndarray], rows: np.ndarray):
        self.centres, self.radii, self.rows = centres, radii, rows
        self.split = centres[0].shape[1]

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half the highest score that ``x`` can have with members of each code."""
        out = []
        for half, part in enumerate((x[: self.split], x[self.split :])):
            spread = np.sqrt((part * part).sum()) * self.radii[half]
            score = self.centres[half] @ part
            # Room for the rounding of doubles, far below the step of 1 between scores of usual size.
            out.append(score + spread + 1e-9 * (np.abs(score) + spread) + 1e-6)
        return out

    def visit(self, x: np.ndarray):
        """``(cell, bound, rows)`` of the cells with rows by falling bound; a heap over the two sorted lists."""
        first, second = self.bounds(x)
        order = [np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")]
        a, b = first[order[0]].tolist(), second[order[1]].tolist()
        codes = [o.tolist() for o in order]
        width = len(b)
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            negative, i, j = heapq.heappop(heap)
            # Each pair enters the heap once: from the pair to its left, or at j = 0 from the one above.
            if j + 1 < width:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            cell = codes[0][i] * width + codes[1][j]
            rows = int(self.rows[cell])
            if rows:
                yield cell, -negative, rows


def _few_of_each_vector(rows: DataFrame, most: int) -> DataFrame:
    """``(id, label, x)`` without repeats, at most ``most`` of each vector and label, those with the smallest ids."""
    smallest = Window.partitionBy("x", "label").orderBy("id")
    return rows.distinct().withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= most).drop("at")


def _coded(rows: DataFrame, centres: list[np.ndarray], size: int) -> DataFrame:
    """``rows`` with their codes c0, c1, and the distances r0, r1 of their halves from the centres."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    split = centres[0].shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(2), size).astype(np.float64)
            c0, r0 = _nearest(x[:, :split], shared.value[0])
            c1, r1 = _nearest(x[:, split:], shared.value[1])
            more = [pa.array(c0, pa.int32()), pa.array(c1, pa.int32()), pa.array(r0), pa.array(r1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["id", "label", "x", "c0", "c1", "r0", "r1"])

    schema = "id long, label int, x array<long>, c0 int, c1 int, r0 double, r1 double"
    return rows.select("id", "label", "x").mapInArrow(run, schema)


def build_index(rows: DataFrame, size: int) -> tuple[DataFrame, Cells]:
    """``(cell, block, id, label, x)`` of every row, and the cells. ``rows`` (id, label, x) must not be empty."""
    n = rows.count()
    codes = min(MOST_CODES, max(1, ceil(sqrt(n / CELL_ROWS))))
    drawn = rows.select("x").orderBy(F.xxhash64("id", "label"), "id").limit(FIT_ROWS)
    sample = np.array([r["x"] for r in drawn.collect()], dtype=np.float64)
    split = (size + 1) // 2
    centres = [codebook(sample[:, :split], codes), codebook(sample[:, split:], codes)]
    coded = stored(_coded(rows, centres, size))
    width = len(centres[1])
    radii = []
    for half in (0, 1):
        widest = np.zeros(len(centres[half]))
        for r in coded.groupBy(f"c{half}").agg(F.max(f"r{half}").alias("r")).collect():
            widest[r[f"c{half}"]] = r["r"]
        radii.append(widest)
    placed = coded.withColumn("cell", F.col("c0") * width + F.col("c1"))
    members = np.zeros(len(centres[0]) * width, dtype=np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MOST_CODES squared
        members[r["cell"]] = r["n"]
    blocks = F.element_at(F.lit(np.maximum(-(-members // BLOCK_ROWS), 1).tolist()), F.col("cell") + 1).cast("long")
    block = F.pmod(F.xxhash64("id", "x"), blocks).cast("int")
    index = stored(placed.select("cell", block.alias("block"), "id", "label", "x"))
    return index, Cells(centres, radii, members)


def _requests(open_: DataFrame, cells: Cells, rows_wanted: int, chunks: int) -> DataFrame:
    """The next cells of each open anchor: its columns, with ``cell``, ``chunk``, and how far the search then is.

    ``open_`` has a, label, x, lows, highs, floors (what a row must reach to matter, one for each window)
    and visited. Each anchor's last row has the cell -1 and carries ``next_bound``, the bound of the first cell
    that was not visited, NULL if none is left, and ``visited``.
    """
    shared = open_.sparkSession.sparkContext.broadcast(cells)
    schema = "a long, cell int, chunk int, visited long, next_bound double"

    def run(batches):
        for batch in batches:
            anchors, taken, chunk, visited, bounds = [], [], [], [], []
            for a, x, least, done in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                here = int(np.uint64(a * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> np.uint64(33)) % chunks
                rows, at, next_bound = 0, 0, None
                for cell, bound, members in shared.value.visit(np.array(x, dtype=np.float64)):
                    if bound < least:
                        break  # no later cell can matter either
                    if at >= done:
                        if rows >= rows_wanted:
                            next_bound = bound
                            break
                        rows += members
                        anchors.append(a), taken.append(cell), chunk.append(here), visited.append(0), bounds.append(None)
                    at += 1
                anchors.append(a), taken.append(-1), chunk.append(here), visited.append(at), bounds.append(next_bound)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors, pa.int64()),
                    pa.array(taken, pa.int32()),
                    pa.array(chunk, pa.int32()),
                    pa.array(visited, pa.int64()),
                    pa.array(bounds, pa.float64()),
                ],
                ["a", "cell", "chunk", "visited", "next_bound"],
            )

    return open_.select("a", "x", F.array_min("floors").alias("least"), "visited").mapInArrow(run, schema)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    most = [max(int(m.max()), -int(m.min()), 1) for m in (anchors, rows)]
    if most[0] * most[1] * anchors.shape[1] < EXACT:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors.astype(object) @ rows.T.astype(object)


def _best(index: DataFrame, asked: DataFrame, size: int, blocks: int, same: bool, k: int) -> DataFrame:
    """``(a, slot, id, score)``: the best ``k`` rows of each window within each pair of block and chunk.

    ``asked`` has cell, chunk, a, label, x, lows, highs, floors, only of cells with rows.
    """
    # New names for what both sides derive from the same table, or Spark takes them for one column.
    chunk_of = asked.groupBy(F.col("cell").alias("asked_cell"), F.col("chunk").alias("met")).agg(F.count(F.lit(1)))
    left = index.join(chunk_of, F.col("cell") == F.col("asked_cell")).select(
        "cell", "block", F.col("met").alias("chunk"), "id", "label", "x"
    )
    if blocks > 1:  # a crowded cell's anchors meet each of its blocks
        per_cell = index.groupBy(F.col("cell").alias("block_cell"), F.col("block").alias("meets")).agg(F.count(F.lit(1)))
        right = asked.join(per_cell, F.col("cell") == F.col("block_cell")).withColumn("block", F.col("meets"))
    else:
        right = asked.withColumn("block", F.lit(0))
    keys = ["cell", "block", "chunk"]
    names = ["a", "slot", "id", "score"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if rows.num_rows and wanted.num_rows:
            x = as_matrix(rows.column("x").combine_chunks(), size)
            ids = rows.column("id").to_numpy()
            labels = rows.column("label").to_numpy()
            order = np.argsort(ids, kind="stable")  # so that ties go to the smaller id
            x, ids, labels = x[order], ids[order], labels[order]
            ax = as_matrix(wanted.column("x").combine_chunks(), size)
            scores = _scores(ax, x)
            own_labels = wanted.column("label").to_numpy()
            a = wanted.column("a").to_pylist()
            owners = wanted.column("owner").to_numpy()
            limits = [wanted.column(c).to_pylist() for c in ("lows", "highs", "floors")]
            for r, (lows, highs, floors) in enumerate(zip(*limits)):
                row = scores[r]
                fits = ((labels == own_labels[r]) == same) & (ids != owners[r])
                for slot, (low, high, floor) in enumerate(zip(lows, highs, floors)):
                    inside = np.flatnonzero(fits & (row >= max(low, floor)) & (row <= high))
                    if len(inside) > k:
                        kth = np.partition(row[inside], len(inside) - k)[len(inside) - k]
                        inside = inside[row[inside] >= kth]
                        inside = inside[np.argsort(-row[inside], kind="stable")[:k]]
                    out[0] += [a[r]] * len(inside)
                    out[1] += [slot] * len(inside)
                    out[2] += ids[inside].tolist()
                    out[3] += [int(s) for s in row[inside]]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names)

    grouped = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return grouped.applyInArrow(run, "a long, slot int, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    once = found.distinct()  # an id with several vectors may reach the same score
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(index: DataFrame, cells: Cells, anchors: DataFrame, size: int, *, same: bool, k: int) -> DataFrame:
    """``(a, slot, rank, id, score)``: the best ``k`` rows in each window of each anchor, exact.

    ``anchors`` has a (their own number), owner (the id they must not find), label, x, and lows and highs, arrays
    with the limits of their windows. ``same`` asks for rows of the anchor's label, else of all others. Rows
    that share an id count once a score.
    """
    n_blocks = int(max(1, -(-int(cells.rows.max()) // BLOCK_ROWS)))
    chunks = max(1, ceil(anchors.count() / CHUNK_ANCHORS))
    open_ = stored(anchors.withColumns({"floors": F.col("lows"), "visited": F.lit(0).cast("long")}))
    kept = None
    rows_wanted = FIRST_ROWS
    while True:
        asked = stored(_requests(open_, cells, rows_wanted, chunks))
        wanted = asked.where("cell >= 0").select("a", "cell", "chunk").join(open_.drop("visited"), "a")
        found = _best(index, wanted, size, n_blocks, same, k)
        if kept is not None:
            found = found.union(kept.drop("rank"))
        kept = stored(_top(found, k))
        # A window with k rows asks no longer for rows below its last: a tie with a smaller id may still come.
        full = kept.where(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("least"))
        ends = asked.where("cell < 0 AND next_bound IS NOT NULL").select("a", "visited", "next_bound")
        raised = F.transform("lows", lambda low, slot: F.greatest(low, F.coalesce(F.try_element_at("least", slot), low)))
        nothing = F.create_map().cast("map<int,bigint>")
        open_ = stored(
            open_.drop("visited")
            .join(ends, "a")
            .join(full, "a", "left")
            .withColumn("least", F.coalesce("least", nothing))
            .withColumn("floors", raised)
            .where(F.col("next_bound") >= F.array_min("floors"))
            .drop("least", "next_bound")
        )
        if open_.isEmpty():
            return kept
        rows_wanted *= ROWS_GROWTH


def labelled_vectors(
    df: DataFrame, *, id_col: str, vector_col: str, label_col: str, scale: int = SCALE
) -> tuple[DataFrame, int]:
    """``(id, label, x)`` of the rows that take part, and the number of dimensions."""
    named = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("v")
    ).where("id IS NOT NULL AND label IS NOT NULL")
    vectors, size = whole_vectors(named, id_col="id", vector_col="v", scale=scale, keep=("label",))
    return vectors.select("id", "label", "x"), size


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    size: int,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` have id, label, x (whole numbers, ``size`` of them). An anchor's positives are its
    ``positives`` best other rows of the same label; for each the first ``negatives`` rows of other labels whose
    score is from ``lowest`` to ``highest`` per cent of the positive's. Higher scores come first, ties by
    smaller id; pairs without a negative give no row.

    Repeated rows count once. Rows that share an id with different vectors or labels are rows of their own,
    but an id that reaches the same score twice is listed once, and an anchor's own id is never its partner.
    Empty tables give an empty result. Sizes of entries times one another, summed, must stay below 2**62.
    """
    spark = rows.sparkSession
    once = stored(_few_of_each_vector(rows, max(positives, negatives) + 1))
    if once.isEmpty():
        return _no_rows(spark)
    index, cells = build_index(once, size)
    asked = stored(anchors.distinct().withColumn("a", F.monotonically_increasing_id()).withColumnRenamed("id", "owner"))
    no_limits = {"lows": F.array(F.lit(-NO_LIMIT)), "highs": F.array(F.lit(NO_LIMIT))}
    best = search(index, cells, asked.withColumns(no_limits), size, same=True, k=positives)
    score = F.col("score")
    windows = best.where(score >= 0).groupBy("a").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), score))).alias("found")
    )
    # 50 * positive <= 100 * negative <= 95 * positive in whole numbers, without leaving long.
    limits = stored(
        asked.join(windows, "a").withColumns(
            {
                "lows": F.transform("found", lambda p: F.ceil(p["score"] * F.lit(lowest).cast("decimal(10,0)") / 100).cast("long")),
                "highs": F.transform("found", lambda p: F.floor(p["score"] * F.lit(highest).cast("decimal(10,0)") / 100).cast("long")),
            }
        )
    )
    if limits.isEmpty():
        return _no_rows(spark)
    mined = search(index, cells, limits.drop("found"), size, same=False, k=negatives)
    named = mined.join(limits.select("a", F.col("owner").alias("anchor_id"), "found"), "a")
    positive = F.col("found")[F.col("slot")]
    return named.select(
        "anchor_id",
        positive["positive_id"].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def _no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


def mine(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_every: int = 50,
    noise_every: int = 7,
    labels: int = 10,
    **options,
) -> DataFrame:
    """:func:`hard_negatives` for the rows whose id is divisible by ``anchor_every``, over all rows.

    Rows without an id, label or vector, with an empty vector, or with a NULL or non-finite entry take no part, nor do
    vectors of another length than most have. Entries become floor(256 * entry). Where the id is divisible by
    ``noise_every``, the label first becomes (label + 1) % ``labels``; 0 leaves labels alone.
    """
    rows, size = labelled_vectors(df, id_col=id_col, vector_col=vector_col, label_col=label_col)
    if noise_every:
        moved = F.when(F.col("id") % noise_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
        rows = rows.withColumn("label", moved)
    rows = stored(rows)
    return hard_negatives(rows, rows.where(F.col("id") % anchor_every == 0), size, **options)
