"""MinHash near-dedup: what fine prints leave is links that join components, not pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from farelens.llm import minhash
from farelens.llm.shingles import overlap, shingle_set


def test_a_large_group_of_near_copies_makes_no_row_a_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = random.Random(8)
    draw = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    template = draw(120)
    texts = []
    for _ in range(150):  # similar to each other by little less or more than 0.75
        at = rng.sample(range(120), rng.choice([1, 2]))
        texts.append(" ".join("y" + str(rng.random()) if k in at else w for k, w in enumerate(template)))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4).cache()
    members = minhash.signed(rows, "id", "t").select("id", F.explode("bands").alias("key"), F.col("id").alias("root"))
    found = minhash._close_links(members, minhash._prints(members, rows), 75).collect()
    sets = [shingle_set(t) for t in texts]
    true = set()
    for i in range(len(sets)):
        for j in range(i):
            o = overlap(sets[i], sets[j])
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                true.add((i, j))
    assert {(r["u"], r["v"]) for r in found} <= true

    def parts(links):
        part = list(range(len(texts)))
        for a, b in links:
            old, new = max(part[a], part[b]), min(part[a], part[b])
            part = [new if p == old else p for p in part]
        return part

    assert parts(true) == parts([(r["u"], r["v"]) for r in found])
    assert len(true) > 1000  # each of which was a row of each bucket it shares
    assert len(found) < 32 * len(texts) and len(set(found)) == len(found)
