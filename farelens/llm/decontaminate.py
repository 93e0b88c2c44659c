"""Benchmark decontamination: Wu-Manber search of texts for all word windows of benchmark items.

Patterns and texts are sequences of words, and a word is one symbol. For the patterns of one length m:

1. The block shift table says for each pair of words how far its nearest place in any pattern lies before
   the pattern's end. Pairs in no pattern allow a jump of m - 1 words, so most of a text is never looked at.
2. Where the shift is nothing, a bucket by the last pair, and within it by the first pair, selects patterns.
3. These are compared with the text word by word.

Words are numbered by the vocabulary of the patterns, so a comparison of numbers is one of words. Patterns
go to executors in groups of at most about ``MOST_WINDOWS`` distinct windows, dealt by hash; each group is one
pass over the texts, so a benchmark of any size is searched whole and what is broadcast stays bounded.
Which items a window belongs to is looked up by a join, not shipped.
"""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import stored

WINDOW = 10
MOST_WINDOWS = 200_000
TABLE_BITS = (10, 24)  # least and most bits of a shift table
REMEMBERED_WORDS = 300_000
PIECE = 256
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_raw_words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall  # capitals still in
_LOWER = {ord(c): d for c, d in zip(CAPITALS, SMALL)}


def words(text: Column) -> Column:
    """The words of a text with A-Z as a-z; NULL has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``(window, item)``, each once: all runs of ``width`` words, joined by spaces, and shorter items whole."""
    split = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("w", i, width), " "))
    return split.where(F.size("w") > 0).select(F.explode(runs).alias("window"), "item").distinct()


class LengthTables:
    """Wu-Manber tables of distinct patterns of one length, rows of word numbers."""

    def __init__(self, patterns: np.ndarray):
        self.length = patterns.shape[1]
        self.block = min(2, self.length)
        places = self.length - self.block + 1
        # Distinct blocks are at most patterns x places; a table of four times as many cells collides little.
        least, most = TABLE_BITS
        self.bits = int(np.clip(int(4 * len(patterns) * places).bit_length(), least, most))
        self.shifts = np.full(1 << self.bits, places, dtype=np.int64)
        for place in range(places):
            np.minimum.at(self.shifts, self.blocks(patterns[:, place : place + self.block]), places - 1 - place)
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for row, pattern in enumerate(patterns.tolist()):
            within = self.buckets.setdefault(tuple(pattern[-self.block :]), {})
            within.setdefault(tuple(pattern[: self.block]), []).append((pattern, row))

    def blocks(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each block; ``rows`` has the words of a block as columns."""
        mixed = rows[:, 0].astype(np.uint64)
        for k in range(1, self.block):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + rows[:, k].astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """``(start, pattern row)`` of every occurrence, by start."""
        n, m, block = len(codes), self.length, self.block
        if n < m:
            return []
        shifts = self.shifts[self.blocks(np.stack([codes[k : n - block + 1 + k] for k in range(block)], axis=1))].tolist()
        text = codes.tolist()
        found = []
        end, step = m - block, 0  # place of the block that ends the present window
        last = n - block
        while end <= last:
            step = shifts[end]
            if step:
                end += step
                continue
            within = self.buckets.get(tuple(text[end : end + block]))
            if within is not None:
                start = end + block - m
                for pattern, row in within.get(tuple(text[start : start + block]), ()):
                    if text[start : start + m] == pattern:
                        found.append((start, row))
            end += 1
        return found


class PatternTables:
    """The tables of one group of windows, for each length, and the numbers of their words."""

    def __init__(self, group: list[str]):
        vocabulary: dict[str, int] = {}
        by_length: dict[int, list] = {}
        for window in group:
            numbers = [vocabulary.setdefault(word, len(vocabulary) + 1) for word in window.split(" ")]
            by_length.setdefault(len(numbers), []).append((numbers, window))
        self.vocabulary = vocabulary
        self.lengths = [
            (LengthTables(np.array([p for p, _ in listed], dtype=np.int64)), [w for _, w in listed])
            for listed in by_length.values()
        ]
        self.known: dict[str, int] = {}

    def codes(self, text: str | None) -> np.ndarray:
        """The number of each word of a text, 0 for words that no pattern holds."""
        known, numbers = self.known, []
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for word in _raw_words(text or ""):
            code = known.get(word)
            if code is None:
                code = known[word] = self.vocabulary.get(word.translate(_LOWER), 0)
            numbers.append(code)
        return np.array(numbers, dtype=np.int64)

    def find(self, text: str | None) -> tuple[int, list[dict], list[str]]:
        """How many words a text has, the runs of words inside occurrences, and the windows that occur."""
        codes = self.codes(text)
        hit = np.zeros(len(codes) + 2, dtype=np.int8)
        seen = []
        if codes.any():
            for tables, names in self.lengths:
                rows = set()
                for start, row in tables.search(codes):
                    hit[start + 1 : start + 1 + tables.length] = 1
                    rows.add(row)
                seen += [names[row] for row in rows]
        edges = np.flatnonzero(np.diff(hit))
        spans = [{"start": s, "stop": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
        return len(codes), spans, seen


FOUND = "row long, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, windows array<string>"


def _search(rows: DataFrame, group: list[str]) -> DataFrame:
    """FOUND of each row of ``rows`` (row, doc_id, text) for one group of windows."""
    tables = rows.sparkSession.sparkContext.broadcast(PatternTables(group))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = ["row", "doc_id", "n_words", "spans", "windows"]

    def run(batches):
        find = tables.value.find
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                found = [find(text) for text in piece.column(2).to_pylist()]
                counts, spans, seen = zip(*found)
                columns = [pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(seen, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], names)

    return rows.mapInArrow(run, FOUND)


def _covered(spans: Column) -> Column:
    """How many words lie in the union of spans, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("up_to"), F.lit(0).cast("long").alias("hit"))

    def add(so_far: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["stop"] - F.greatest(so_far["up_to"], span["start"]))
        return F.struct(
            F.greatest(so_far["up_to"], span["stop"]).alias("up_to"), (so_far["hit"] + fresh).cast("long").alias("hit")
        )

    return F.aggregate(F.array_sort(spans), start, add)["hit"]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, spans, items, contaminated.

    ``spans`` are runs of words (from start up to, without, stop, counted from 0) inside occurrences, one list
    per group of windows, so spans of different groups may overlap; ``n_hit`` counts each word once.
    ``items`` are the ids, as sorted strings, of all items with a window in the text.

    NULL and wordless texts have no words and no hits; wordless items match nothing. Rows of the benchmark
    that share an id are one item; windows of items without an id mark words but name no item. Rows of
    ``docs`` are judged each, whatever their id, NULL included. Without benchmark rows nothing is hit; an
    empty table of documents gives an empty result; other columns of both tables are ignored.
    """
    listed = stored(windows(benchmark, item_col=item_col, text_col=item_text_col, width=width))
    distinct = listed.select("window").distinct()
    n_groups = max(1, ceil(distinct.count() / most_windows))
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(n_groups)))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")
    )
    if n_groups > 1:  # every pass must see the same row numbers
        rows = stored(rows)
    found = None
    for part in range(n_groups):
        group = sorted(r["window"] for r in dealt.where(F.col("part") == part).select("window").toLocalIterator())
        one = stored(_search(rows, group))
        found = one if found is None else found.union(one)
    if n_groups > 1:
        found = found.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("windows")).alias("windows"),
        )
    hits = found.select("row", F.explode("windows").alias("window"))
    named = (
        hits.join(listed.where("item IS NOT NULL"), "window")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return found.join(named, "row", "left").select(
        "doc_id",
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        "spans",
        F.coalesce("items", none).alias("items"),
        (F.size("spans") > 0).alias("contaminated"),
    )
