"""NN-descent: groups of a cell share its vectors, and a vector leaves it with its nearest others only."""

from __future__ import annotations

import numpy as np
import pandas as pd

from farelens.llm import neighbours


def test_a_cell_reports_each_pair_once_and_the_nearest_of_all_groups():
    rng = np.random.default_rng(4)
    names = np.arange(100, 160)
    vecs = rng.standard_normal((60, 8))
    groups = [(g, m) for g in range(12) for m in {*rng.choice(names, 30).tolist(), 100}]
    got = neighbours._introduce(
        pd.DataFrame(groups, columns=["id", "other"]), pd.DataFrame({"name": names[::-1], "vec": list(vecs[::-1])})
    )
    assert not got.duplicated(["id", "other"]).any()
    assert (got.groupby("id").size() <= neighbours.NEIGHBOURS).all()
    want = ((vecs[got["id"] - 100] - vecs[got["other"] - 100]) ** 2).sum(axis=1)
    assert np.allclose(got["dist"], want)
    near = ((vecs - vecs[0]) ** 2).sum(axis=1).argsort()[1:6] + 100  # 100 is in every group
    met = {m for _, m in groups}
    assert {n for n in near.tolist() if n in met} <= set(got[got["id"] == 100]["other"])


def test_cells_are_bounded_and_cover_all(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MEETING_ROWS", 20)
    rows = [(k, [1.0 + (k % 3) * 1e-3, 2.0]) for k in range(300)]  # all near each other
    cells = neighbours._cells(spark.createDataFrame(rows, "id long, vec array<double>")).collect()
    assert sorted(r["id"] for r in cells) == list(range(300))
    sizes = pd.Series([r["cell"] for r in cells]).value_counts()
    assert len(sizes) >= 12 and sizes.max() <= 60
