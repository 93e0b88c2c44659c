"""Wu-Manber decontamination against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from farelens.llm import decontaminate

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, item_id string, n_words string, row string, windows string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, width=10):
    named = [(i, words_of(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        ws = words_of(text)
        hit, found = set(), set()
        for item, iw in named:
            m = min(width, len(iw))
            patterns = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)} if m else set()
            for k in range(len(ws) - m + 1) if m else ():
                if tuple(ws[k : k + m]) in patterns:
                    hit |= set(range(k, k + m))
                    found.add(item)
        out.append((doc_id, len(ws), len(hit), tuple(sorted(str(i) for i in found if i is not None)), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    full = [(i, t, "a", "b", "c", "d") for i, t in docs]
    shown = [(i, t, "x", "y", "z", "u") for i, t in items]
    names = "item_id long, text string, doc_id string, window string, row string, item string"
    return spark.createDataFrame(full, DOCS).repartition(3), spark.createDataFrame(shown, names)


def corpus():
    rng = random.Random(4)
    vocabulary = ["Der", "die", "DAS", "über", "ÜBER", "a", "bc", "7", "東京", "x1"]

    def prose(n):
        return rng.choice(["", "-", "\n"]).join([]) + " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(k, prose(rng.choice([1, 2, 3, 9, 10, 11, 25]) if k > 3 else 30)) for k in range(14)]
    items = [(i, t) for i, t in items if len(words_of(t)) > 2]
    items += [(2, prose(12)), (None, prose(15)), (50, None), (51, " ?! "), (52, "the the the the the the the the the the the the")]
    texts = [None, "", "...", "the " * 40, "the " * 9, prose(3000)]
    for _, t in items:
        ws = (t or "").split(" ")
        texts += [t, prose(20) + " " + (t or "").upper() + " " + prose(5), "zz " + "_".join(ws) + "'zz", " ".join(ws[1:11])]
    docs = list(enumerate(texts)) + [(3, texts[3]), (None, texts[8])]
    return docs, items


@pytest.mark.parametrize("most", [200_000, 7])
def test_contamination(spark, most):
    docs, items = corpus()
    got = decontaminate.find_contamination(*tables(spark, docs, items), most_windows=most).collect()
    shown = sorted(
        ((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got), key=repr
    )
    assert shown == brute(docs, items)
    assert any(r["contaminated"] for r in got) and not all(r["contaminated"] for r in got)


def test_empty_tables(spark):
    docs, items = tables(spark, [], [])
    some_docs, some_items = tables(spark, [(1, "a b c"), (None, None)], [(1, "a b c")])
    assert decontaminate.find_contamination(docs, some_items).count() == 0
    clean = decontaminate.find_contamination(some_docs, items).collect()
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in clean) == [(0, 0, []), (3, 0, [])]
    wordless = tables(spark, [], [(1, None), (2, "--")])[1]
    assert not any(r["contaminated"] for r in decontaminate.find_contamination(some_docs, wordless).collect())


@pytest.mark.parametrize("length", [1, 2, 3, 10])
def test_search_finds_every_occurrence(length):
    rng = np.random.default_rng(length)
    for top in (2, 3, 8):
        patterns = np.unique(rng.integers(1, top, size=(30, length)), axis=0)
        codes = rng.integers(0, top, size=400)
        tables_ = decontaminate.LengthTables(patterns)
        want = {
            (s, k) for s in range(400 - length + 1) for k, p in enumerate(patterns.tolist()) if codes[s : s + length].tolist() == p
        }
        assert set(tables_.search(codes)) == want
