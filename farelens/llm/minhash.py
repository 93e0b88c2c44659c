"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

1. Each text becomes the set of its word shingles and one signature: the set is hashed once, the hash
   range is cut into bins, each bin keeps its least value, and an empty bin borrows the value of a
   full one found by a fixed random walk (optimal densification).
2. Rows with equal sets are one class; only the row with the smallest id goes on.
3. Each band of the signature is a bucket key. In each round a bucket offers edges from one pivot to its
   members of other components, the first time from the smallest id, then from drawn ones, for as long as
   this finds links. So a bucket of one component, however large, costs one edge a row and round.
4. Offered edges are confirmed on the full sets; confirmed links make components, and buckets of a single one
   are done.
5. What is still open, such as texts that share a template, is compared by fine prints: four more one-permutation
   signatures, a byte a bin. Crowded buckets are first split by bands of these. A task holds two blocks of a
   bucket with their texts, confirms pairs of different components whose prints agree as those of similar
   texts do on the full sets, and puts out only the links that join components. So no pair is ever a row
   that is not such a link, and a pair that shares several buckets is compared in one of them.
6. Components of all confirmed links give each row the smallest id it reaches.

A pair of similarity 0.75 is missed, if nothing else links it, where no band agrees (probability 5e-6), where its
prints agree by chance as those of texts below 0.65 (about 3e-7), or, in crowded buckets only, in no band of
the prints (6e-8).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelens.llm.common import stored
from farelens.llm.graph import components, open_members
from farelens.llm.shingles import mixed, overlap, shingle_set

BANDS = 32
ROWS = 4  # at similarity 0.75 a pair misses all bands with probability 5e-6
BINS = BANDS * ROWS
PROBES = 64
SIMILARITY = 75  # per cent
PIECE = 256
LEAST_FOUND = 0.01  # share of offered star edges that must be links for another such round
PRINTS = 4  # further signatures, of BINS bytes each
PRINT_BYTES = PRINTS * BINS
PRINT_ROWS = 6  # bytes of a band of the prints
PRINT_BANDS = PRINT_BYTES // PRINT_ROWS
BLOCK = 512  # members of a bucket that one task compares with as many others
# Members of an open bucket that is split by these bands. A member is copied to each block of its bucket or, split,
# to each band, so splitting pays once there are more blocks than bands.
CROWDED = PRINT_BANDS * BLOCK
DEVIATIONS = 5  # of the estimated similarity that a pair may lie below the wanted one

_BIN_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
# A fixed walk over the bins for each empty bin; a bin and an attempt give the same place in every text.
_WALK = (
    mixed(np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(1, PROBES + 1, dtype=np.uint64))
    % np.uint64(BINS)
).astype(np.int64)
_BAND_MIX = mixed(np.arange(1, BINS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value per bin; ``shingles`` is sorted, has no repeats and is not empty."""
    first = np.searchsorted(shingles, _BIN_STARTS)
    after = np.append(first[1:], len(shingles))
    full = first < after
    values = np.where(full, shingles[np.minimum(first, len(shingles) - 1)], np.uint64(0))
    empty = np.flatnonzero(~full)
    for attempt in range(PROBES):
        if not len(empty):
            return values
        at = _WALK[empty, attempt]
        found = full[at]
        values[empty[found]] = values[at[found]]
        empty = empty[~found]
    # Practically never reached: walk on from the bin itself to the next full one.
    places = np.flatnonzero(full)
    values[empty] = values[places[np.searchsorted(places, empty) % len(places)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    grouped = values.reshape(BANDS, ROWS)
    return mixed((mixed(grouped) * _BAND_MIX).sum(axis=1, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_key, bands) of each row; without words set_key and bands are NULL."""
    schema = T.StructType.fromDDL("id long, n_shingles long, set_key binary, bands array<long>")

    def run(batches):
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                counts, keys, bands = [], [], []
                for text in piece.column(1).to_pylist():
                    shingles = shingle_set(text)
                    counts.append(len(shingles))
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                    bands.append(band_keys(signature(shingles)) if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    schema.names,
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def _similar(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    left = texts.select(F.col("id").alias("u"), F.col("t").alias("tu"))
    right = texts.select(F.col("id").alias("v"), F.col("t").alias("tv"))
    with_texts = pairs.join(left, "u").join(right, "v")

    def run(batches):
        sets: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in sets:
                if len(sets) >= PIECE:
                    sets.clear()
                sets[node] = shingle_set(text)
            return sets[node]

        for pdf in batches:
            keep = []
            for u, v, tu, tv in zip(pdf["u"], pdf["v"], pdf["tu"], pdf["tv"]):
                a, b = of(u, tu), of(v, tv)
                shared = overlap(a, b)
                keep.append(100 * shared >= similarity * (len(a) + len(b) - shared))
            yield pdf.loc[pd.Series(keep, index=pdf.index, dtype=bool), ["u", "v"]]

    return with_texts.mapInPandas(run, "u long, v long")


def _pivots(members: DataFrame, attempt: int) -> DataFrame:
    """One pivot of each bucket: first the smallest id, then one drawn from the bucket's largest component."""
    drawn = F.xxhash64(F.lit(attempt), "key", "id") if attempt else F.lit(0).cast("long")
    wanted = members if not attempt else members.where("root = big")
    least = wanted.groupBy("key").agg(F.min(F.struct(drawn.alias("drawn"), "id", "root")).alias("pivot"))
    return least.select("key", "pivot.id", "pivot.root")


def _star_edges(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges from each bucket's pivots to its members in other components. Both: (key, id, root)."""
    centres = chosen.select("key", F.col("id").alias("pivot_id"), F.col("root").alias("pivot_root"))
    offered = members.join(centres, "key").where("root != pivot_root")
    return offered.select(F.greatest("id", "pivot_id").alias("u"), F.least("id", "pivot_id").alias("v")).distinct()


def fine_print(shingles: np.ndarray) -> np.ndarray:
    """``PRINT_BYTES`` bytes; those of two texts agree with about the probability of their similarity."""
    seeds = mixed(np.arange(1, PRINTS + 1, dtype=np.uint64))
    bins = [mixed(signature(np.sort(mixed(shingles ^ seed)))) for seed in seeds]
    return (np.concatenate(bins) >> np.uint64(56)).astype(np.uint8)


def _prints(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, print, own_bands, t) of the texts that still have an open bucket."""
    wanted = texts.join(members.select("id").distinct(), "id", "left_semi")
    schema = T.StructType.fromDDL("id long, print binary, own_bands binary, t string")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                prints, bands = [], []
                for text in piece.column(1).to_pylist():
                    shingles = shingle_set(text)
                    prints.append(fine_print(shingles).tobytes() if len(shingles) else None)
                    bands.append(band_keys(signature(shingles)).tobytes() if len(shingles) else None)
                made = [pa.array(prints, pa.binary()), pa.array(bands, pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column(0), *made, piece.column(1)], schema.names)

    # A blank text can share its id with one that has words.
    return stored(wanted.select("id", "t").mapInArrow(run, schema).where("print IS NOT NULL"))


def _split(members: DataFrame, prints: DataFrame) -> DataFrame:
    """(key, id, root, whole, at): members of small buckets as they are (``at`` is -1); crowded ones are replaced by
    those of equal bands of prints within them, ``whole`` being the bucket and ``at`` the band."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    small = members.join(sizes.where(F.col("n") <= CROWDED).select("key"), "key")
    crowded = members.join(sizes.where(F.col("n") > CROWDED).select("key"), "key").join(prints, "id")
    cut = f"substring(print, at * {PRINT_ROWS} + 1, {PRINT_ROWS})"
    bands = F.expr(f"transform(sequence(0, {PRINT_BANDS - 1}), at -> xxhash64(key, at, {cut}))")
    banded = crowded.select("id", "root", F.col("key").alias("whole"), F.posexplode(bands).alias("at", "key")).distinct()
    full = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    columns = ["key", "id", "root", "whole", "at"]
    whole = small.select("key", "id", "root", F.col("key").alias("whole"), F.lit(-1).alias("at"))
    return whole.union(banded.join(full, "key").select(*columns))


def _close_links(members: DataFrame, prints: DataFrame, similarity: int) -> DataFrame:
    """(u, v): links that join what lies in different components within the tiles, no more than members less one a tile.

    A pair of members is compared in one tile only: in the least bucket that both are in, and, where that is split, at
    the first band of prints in which they agree. Close prints are confirmed there on the full sets.
    """
    split = stored(_split(members, prints))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sizes = split.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = split.join(sizes, "key").withColumn("own", own)
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = placed.select("*", F.explode(others).alias("other")).select(
        "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "whole", "at", "own", "id", "root"
    )
    wanted = similarity / 100
    agreeing = wanted - DEVIATIONS * np.sqrt(wanted * (1 - wanted) / PRINT_BYTES)
    least = PRINT_BYTES * (agreeing + (1 - agreeing) / 256)  # unequal bins agree in a byte by chance
    none = np.iinfo(np.int64).max

    def compared(tile: list, one_block: bool, whole: int, at: int) -> pa.RecordBatch:
        ids, roots, own, prints_, bands, texts = (np.concatenate(part) for part in zip(*tile))
        u, v = [], []
        left = np.flatnonzero(own == own.min())
        right = np.flatnonzero(own == own.max())
        if not one_block and own.min() == own.max():
            left = left[:0]  # the other block of the tile has no members
        present, part_of, counts = np.unique(roots, return_inverse=True, return_counts=True)
        big = roots == present[counts.argmax()]  # its members meet the others when those are held against them
        sets: dict[int, np.ndarray] = {}

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i])
            return sets[i]

        for i in left if len(present) > 1 else ():
            if one_block and big[i]:
                continue
            against = right[part_of[right] != part_of[i]]
            if one_block:
                against = against[(against > i) | big[against]]
            common = np.where(bands[against] == bands[i], bands[i], none).min(axis=1, initial=none)
            against = against[common == whole]
            near = against[(prints_[against] == prints_[i]).sum(axis=1) >= least]
            if at >= 0:
                cut = PRINT_BANDS * PRINT_ROWS
                agree = (prints_[near, :cut] == prints_[i, :cut]).reshape(-1, PRINT_BANDS, PRINT_ROWS).all(axis=2)
                near = near[agree[:, at] & (agree.argmax(axis=1) == at)]
            for j in near.tolist():
                if part_of[i] == part_of[j]:
                    continue  # joined by a link found before
                x, y = set_of(int(i)), set_of(j)
                shared = overlap(x, y)
                if 100 * shared >= similarity * (len(x) + len(y) - shared):
                    u.append(max(ids[i], ids[j]))
                    v.append(min(ids[i], ids[j]))
                    part_of[part_of == part_of[j]] = part_of[i]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    order = ["key", "a", "b", "whole", "at"]

    def run(batches):
        now, tile = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                keys = np.stack([piece.column(k).to_numpy() for k in range(len(order))], axis=1)
                columns = [piece.column(k).to_numpy() for k in (6, 7, 5)]
                for k, kind, width in ((8, np.uint8, PRINT_BYTES), (9, np.int64, BANDS)):
                    columns.append(np.frombuffer(b"".join(piece.column(k).to_pylist()), kind).reshape(-1, width))
                columns.append(np.array(piece.column(10).to_pylist(), dtype=object))
                edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for first, last in zip(edges, edges[1:]):
                    key = tuple(keys[first].tolist())
                    if key != now:
                        if tile:
                            yield compared(tile, now[1] == now[2], *now[3:])
                        now, tile = key, []
                    tile.append([c[first:last] for c in columns])
        if tile:
            yield compared(tile, now[1] == now[2], *now[3:])

    dealt = tiles.join(prints, "id").select(*order, "own", "id", "root", "print", "own_bands", "t").repartition(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A-Z counts as a-z. A text with fewer words than a shingle is one shingle; a NULL or blank text has
    none, is linked with nothing and is its own component. Rows that share an id are one node and
    get its component; rows without an id (NULL) link with nothing. ``kept`` is doc_id =
    component_id. An empty table gives an empty result, other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    rows = stored(signed(source, "id", "t"))
    usable = rows.where("set_key IS NOT NULL AND id IS NOT NULL")
    classes = stored(usable.groupBy("set_key").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("n")))
    copies = (
        usable.join(classes.where("n > 1"), "set_key")
        .where("id != root")
        .select(F.col("id").alias("u"), F.col("root").alias("v"))
    )
    leaders = usable.join(classes.select("set_key", "root"), "set_key").where("id = root")
    buckets = leaders.select("id", F.explode("bands").alias("key")).distinct()
    crowded = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = buckets.join(crowded, "key").select("key", "id", F.col("id").alias("root"), F.col("id").alias("big"))
    members = stored(members)
    # Only rows that share a bucket are ever compared, so only their texts are shuffled on.
    wanted = members.select("id").distinct()
    texts = stored(source.where("id IS NOT NULL").join(wanted, "id", "left_semi"))

    links, attempt = copies, 0
    while True:
        offered = stored(_star_edges(members, _pivots(members, attempt)))
        found = stored(_similar(offered, texts, similarity))
        roots = stored(components(links.union(found)))
        members = stored(open_members(members, roots))
        # Components are links enough for those of the next round.
        links, attempt = roots.select(F.col("node").alias("u"), F.col("root").alias("v")), attempt + 1
        if found.count() <= LEAST_FOUND * offered.count():
            break
    if not members.isEmpty():
        close = stored(_close_links(members, _prints(members, texts), similarity))
        roots = stored(components(links.union(close)))
    return (
        rows.join(roots.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component_id", F.coalesce("root", "id"))
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``docs``: that with the group's smallest id, and of several rows with this id the
    first by text. Rows without an id (NULL) are in no group and stay."""
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col).where("doc_id IS NOT NULL")
    ids = stored(judged.groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    special = ids.where("NOT kept OR n > 1").select(F.col("doc_id").alias("_near_id"))
    # These ids grow with the table, so the join is the same at every size: both sides are shuffled.
    single = docs.join(special.hint("merge"), F.col(id_col) == F.col("_near_id"), "left_anti")
    # Ids of several rows are rare. Stored, so that Spark sees how few they are and moves no other rows for them.
    several = stored(ids.where("kept AND n > 1").select(F.col("doc_id").alias("_near_id")))
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    of_several = docs.join(several, F.col(id_col) == F.col("_near_id"), "left_semi")
    one_each = of_several.withColumn("_near_at", F.row_number().over(first)).where("_near_at = 1").drop("_near_at")
    return single.unionByName(one_each)
