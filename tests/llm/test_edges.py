"""NULL and repeated ids, ties, and columns named like the operators' own."""

from __future__ import annotations

import hashlib
import random

import pytest

from farelens.llm import bpe, html_text, lines, minhash, neighbours, passages, quality, repeats, shards
from farelens.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, root string, group string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(3)


SHARED = prose(1, 80)
ROWS = [
    (3, prose(2, 20) + " " + SHARED),
    (3, prose(2, 20) + " " + SHARED),
    (5, SHARED + " " + prose(3, 30)),
    (None, SHARED),
    (None, None),
    (7, None),
    (8, ""),
    (9, prose(4, 60)),
    (9, prose(5, 60)),
]


def test_passages_of_repeated_and_nameless_rows(spark):
    got = passages.near_passages(table(spark, ROWS)).collect()
    assert {(r["doc_id"], r["other_id"], r["class_id"]) for r in got} == {(5, 3, 3)}
    assert [r["n_words"] for r in got] == [80]


def test_repeats_of_repeated_and_nameless_rows(spark):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.cut_repeats(table(spark, ROWS)).collect()]
    sizes = sorted((i is None, i or 0, len((t or "").encode())) for i, t in ROWS)
    assert sorted((i is None, i or 0, n) for i, n, _ in got) == sizes
    removed = {i: n for i, _, n in got if n}
    assert removed == {5: len(SHARED)} or removed == {5: len(SHARED) + 1}


def test_minhash_quality_lines_and_codes_keep_every_row(spark):
    docs = table(spark, ROWS)
    assert minhash.near_duplicates(docs).count() == len(ROWS)
    judged = quality.judge(docs).collect()
    assert len(judged) == len(ROWS) and sum(r["base_failed"] for r in judged) == 3
    cleaned = lines.drop_boilerplate(docs)
    assert cleaned.count() == len(ROWS) and cleaned.columns[: len(docs.columns)] == docs.columns
    coded = bpe.encode_and_decode(docs, tokenizer_path()).collect()
    assert sorted(r["decoded"] for r in coded) == sorted(t or "" for _, t in ROWS)


def test_neighbours_with_own_column_names_and_ties(spark):
    rows = [(i, [float(i % 3), 1.0], "a", "b", "c") for i in range(30)] + [(None, [0.0, 1.0], "a", "b", "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank string, score string")
    got = neighbours.nearest_neighbours(vectors, vectors.where("vec_id = 3"), k=4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 0.0), (6, 0.0), (9, 0.0), (12, 0.0)]


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(9)] + [(20, [1.0]), (21, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(vectors, vectors.where("vec_id IN (0, 20, 21)"), k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_pages_with_own_column_names(spark):
    pages = spark.createDataFrame([(1, "u", "<p>One line.</p>", "old", "x")], "page_id long, url string, html string, text string, n_chars string")
    (row,) = html_text.extract(pages).collect()
    assert (row["page_id"], row["text"], row["n_chars"]) == (1, "One line.", 9) and len(row) == 4


def claimed(names, size):
    """The table by the rule: in turns, each takes the first slot of its permutation that is free."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    walks = [
        iter([(number(f"offset:{n}") + k * (number(f"skip:{n}") % (size - 1) + 1)) % size for k in range(size)])
        for n in names
    ]
    owner = {}
    while True:
        for shard, walk in enumerate(walks):
            owner[next(slot for slot in walk if slot not in owner)] = shard
            if len(owner) == size:
                return [owner[slot] for slot in range(size)]


@pytest.mark.parametrize("names, size", [(["a"], 7), (["a", "b", "c"], 101), ([f"s{i}" for i in range(20)], 1009), (["x", "y"], 2)])
def test_the_lookup_table_is_claimed_in_turns(names, size):
    assert shards.lookup_table(names, size) == claimed(names, size)


def test_equal_and_missing_keys_share_a_shard(spark):
    placed = shards.assign_shards(table(spark, ROWS), ["a", "b", "c"], table_size=101).collect()
    assert len(placed) == len(ROWS)
    assert len({r["shard"] for r in placed if r["doc_id"] is None}) == 1
    assert len({r["shard"] for r in placed if r["doc_id"] == 9}) == 1
