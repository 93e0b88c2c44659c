"""MinHash near-dedup: share of close links found, and one row per group."""

from __future__ import annotations

import random

import numpy as np
import pytest

from farelens.llm import minhash
from farelens.llm.shingles import overlap, shingle_set


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def close_pair(rng, n):
    """Two texts of similarity 0.75 or little more."""
    a = words(rng, n)
    b, order = list(a), rng.sample(range(n), n)
    similarity, before = 1.0, b
    for at in order:
        changed = [*b[:at], "x" + b[at], *b[at + 1 :]]
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(changed))
        similarity = overlap(x, y) / (len(x) + len(y) - overlap(x, y))
        if similarity < 0.75:
            break
        b = before = changed
    return " ".join(a), " ".join(before)


def test_close_pairs_are_linked(spark):
    rng = random.Random(12)
    texts = [t for k in range(400) for t in close_pair(rng, rng.choice([20, 60, 150]))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table).collect()}
    missed = [k for k in range(0, len(texts), 2) if got[k + 1] != k]
    # 5e-6 a pair is what independent bands would miss; short texts have fewer bins of their own.
    assert len(missed) <= 1


def test_prints_agree_as_often_as_texts_are_similar():
    rng = random.Random(3)
    found = []
    for n in (30, 200):
        for _ in range(30):
            a, b = (shingle_set(t) for t in close_pair(rng, n))
            wanted = overlap(a, b) / (len(a) + len(b) - overlap(a, b))
            agreed = np.mean(minhash.fine_print(a) == minhash.fine_print(b))
            found.append(((agreed - 1 / 256) / (255 / 256) - wanted))
    assert abs(np.mean(found)) < 0.02 and np.std(found) < 0.06


@pytest.mark.parametrize("crowded, block", [(1024, 512), (4, 3)])
def test_open_buckets_of_a_template_lose_no_link(spark, monkeypatch, crowded, block):
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    template = words(rng, 60)
    texts = []
    for k in range(120):
        own = words(rng, 30)
        texts.append(" ".join(template + own))
        if k % 4 == 0:
            texts.append(" ".join(template + own[:-2] + words(rng, 2)))
    sets = [shingle_set(t) for t in texts]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            o = overlap(a, sets[j])
            if 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table).collect()}
    assert got == dict(enumerate(want)) and 20 < len(set(want)) < len(texts)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(words(random.Random(1), 40))
    other = " ".join(words(random.Random(2), 40))
    rows = [(5, text, "a"), (5, text, "b"), (7, text, "c"), (None, text, "d"), (None, text, "e"), (9, other, "f"), (9, None, "g"), (11, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _near_at string").withColumnRenamed("_near_at", "kept")
    got = minhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert sorted(str(r[0]) for r in kept) == ["11", "5", "9", "None", "None"]
    assert (9, other, "f") in kept
