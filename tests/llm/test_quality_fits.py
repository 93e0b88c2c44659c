"""The robust fits against the same steps in plain Python, and verdicts on rows rather than ids."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from farelens.llm import quality

NAMES, SIZE = quality.NAMES, quality.SIZE
FLOORS = np.diag([quality.STATISTICS[n] ** 2 for n in NAMES])


def start(x):
    q = np.percentile(x, [25, 50, 75], axis=0) / quality.UNIT
    return q[1], np.diag(1 / (((q[2] - q[0]) / 1.349) ** 2 + np.diag(FLOORS)))


def distances(x, fit):
    centred = x / quality.UNIT - fit[0]
    return np.maximum(np.einsum("ri,ij,rj->r", centred, fit[1], centred), 0)


def step(x, fit):
    bins = np.floor(np.log(1 + distances(x, fit)) * quality.BINS_PER_UNIT).astype(int)
    last = next(b for b in sorted(set(bins)) if (bins <= b).sum() >= quality.SHARE * len(x))
    near = x[bins <= last] / quality.UNIT
    covariance = (near.T @ near / len(near) - np.outer(near.mean(0), near.mean(0))) * quality.CONSISTENCY + FLOORS
    return near.mean(0), np.linalg.inv(covariance)


def settled(x):
    fit = start(x)
    for _ in range(200):
        new = step(x, fit)
        if np.allclose(new[0], fit[0], rtol=1e-12) and np.allclose(new[1], fit[1], rtol=1e-9):
            return new
        fit = new
    raise AssertionError("does not settle")


def drawn(seed, n):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(0, 1, (SIZE, SIZE))
    x = np.abs(rng.normal(0, 150, (n, SIZE)) @ mixed + 900 * seed)
    x[: n // 10] += 20_000
    return np.minimum(x.round(), quality.MOST * quality.UNIT).astype(int)


def test_fits_equal_those_of_plain_python(spark):
    groups = {"a": drawn(1, 400), "b": drawn(2, 90), "c": np.full((70, SIZE), 500), "d": drawn(3, 61)}
    rows = [(g, *map(int, r)) for g, x in groups.items() for r in x]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, ["group", *["x_" + n for n in NAMES]]).repartition(5)
    fits = quality.robust_fits(table)
    got = {r["group"]: (np.array(r["fit"]["mean"]), np.array(r["fit"]["inverse"]).reshape(SIZE, SIZE)) for r in fits.collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        want = settled(x)
        assert np.allclose(got[g][0], want[0], rtol=1e-9) and np.allclose(got[g][1], want[1], rtol=1e-6, atol=1e-9)
    measured = table.join(fits, "group").selectExpr("group", *["x_" + n for n in NAMES], quality.squared_distance() + " AS d2")
    for r in measured.collect():
        want = distances(np.array([[r["x_" + n] for n in NAMES]]), settled(groups[r["group"]]))[0]
        assert math.isclose(r["d2"], want, rel_tol=1e-6, abs_tol=1e-6)
    again = quality.step(table, fits)
    assert sorted(r["group"] for r in again.join(fits, ["group", "fit"]).collect()) == sorted(groups)


def text(rng, junk):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(80)]
    return " ".join(w + ("%%%" if junk else "") for w in words)


@pytest.mark.parametrize("least, judged", [(60, True), (10_000, False)])
def test_rows_are_dropped_by_their_own_verdict(spark, least, judged):
    rng = random.Random(2)
    rows = [(i % 50, text(rng, i % 10 == 0), "en", "s", 1, "clash", "x") for i in range(200)]
    rows += [(None, text(rng, True), "en", "s", 1, "clash", "x"), (None, text(rng, False), None, None, 1, "clash", "x")]
    rows += [rows[1], rows[1], (7, "", "en", "s", 0, "clash", "x"), (8, None, "en", None, 0, "clash", "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    kept = quality.drop_rejected(docs, least_rows=least)
    assert kept.columns == docs.columns

    def stays(row):
        return row[1] not in (None, "") and not (judged and "%" in row[1])

    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(r) for r in rows if stays(r))
    assert quality.drop_rejected(docs.limit(0)).count() == 0
