"""Whitening and hard-negative mining against plain Python."""

from __future__ import annotations

import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from farelens.llm import negatives, spectrum, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n string, component string, x string, score string"


def table(spark, rows):
    full = [(*r, *([None] * (3 - len(r))), "a", "b", "c", "d") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def drawn(n, size, seed=3, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread * (1 + k / 3)) for k in range(size)] for _ in range(n)]


BAD = [None, [], [0.5, None, 0.1, 0.2], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]]


def polynomial_by_fractions(matrix):
    """Faddeev-LeVerrier with fractions."""
    size = len(matrix)
    exact = [[Fraction(x) for x in row] for row in matrix]
    out, m = [Fraction(1)], [[Fraction(0)] * size for _ in range(size)]
    for k in range(1, size + 1):
        m = [[m[i][j] + (out[-1] if i == j else 0) for j in range(size)] for i in range(size)]
        m = [[sum(exact[i][t] * m[t][j] for t in range(size)) for j in range(size)] for i in range(size)]
        out.append(-sum(m[i][i] for i in range(size)) / k)
    return [int(c) for c in out]


@pytest.mark.parametrize("size, rank", [(1, 1), (2, 2), (6, 6), (6, 3), (9, 9)])
def test_characteristic_polynomial(spark, size, rank):
    rng = np.random.default_rng(size)
    x = rng.integers(-2000, 2000, size=(40, rank)) @ np.triu(rng.integers(1, 4, size=(rank, size)))
    matrix = [[int(v) for v in row] for row in x.T @ x]
    coefficients = spectrum.characteristic_polynomial(spark, matrix)
    assert coefficients == polynomial_by_fractions(matrix)
    assert spectrum.roots_above(coefficients, 0) == rank
    values = np.linalg.eigvalsh(np.array(matrix, dtype=float))[::-1]
    found = spectrum.leading_roots(coefficients, size, 40)
    listed = [root / 2**40 for root, times in found for _ in range(times)]
    assert listed == pytest.approx(values[:rank].tolist(), rel=1e-9, abs=1e-6 * values[0])


def test_equal_and_close_roots(spark):
    matrix = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0]]
    found = spectrum.leading_spectrum(spark, matrix, 8)
    assert found.eigenvalues == [5.0, 5.0, 2.0]
    assert found.shares == pytest.approx([5 / 12, 5 / 12, 2 / 12])
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(3), atol=1e-15)
    assert np.allclose(np.array(matrix) @ found.vectors, found.vectors * found.eigenvalues, atol=1e-14)
    # Two eigenvalues that differ in the 17th digit still have their own vectors.
    big = 10**17
    close = spectrum.leading_spectrum(spark, [[big + 1, 0], [0, big]], 2)
    assert np.allclose(np.abs(close.vectors), np.eye(2), atol=1e-15)


@pytest.mark.parametrize("size, n", [(4, 60), (12, 200)])
def test_whiten(spark, size, n):
    rows = [(i, v) for i, v in enumerate(drawn(n, size))] + [(None, drawn(1, size, 9)[0]), (3, drawn(n, size)[3])]
    bad = [v for v in BAD if v is None or len(v) != size or size == 4]
    df = table(spark, [(i, v, 0) for i, v in rows] + [(900 + k, v, 1) for k, v in enumerate(bad)])
    got = whitening.whiten(df).collect()
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(int) + 100_000
    count, total = len(rows), x.sum(axis=0)
    covariance = np.cov(x.T.astype(float), bias=True)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(8, size)
    assert len(got) == kept * count and {r["n"] for r in got} == {count}
    want = (x - total / count) @ vectors[:, :kept] / np.sqrt(values[:kept])
    by_key = {}
    for r in got:
        by_key.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    signs = None
    for k, (i, _) in enumerate(rows):
        deviation = sum((count * int(a) - int(s)) ** 2 for a, s in zip(x[k], total))
        found = np.array([by_key[i, Decimal(deviation)][c] for c in range(1, kept + 1)])
        signs = np.sign(found * want[k]) if signs is None else signs
        assert np.allclose(found, signs * want[k], atol=1e-9)


def test_whiten_without_spread_and_empty(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0
    flat = whitening.whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.75, 0.25]), (3, [1.0, 0.25])])).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == 1.0


def test_products_of_any_size_are_exact():
    rng = random.Random(5)
    for top in (10, 2**25, 2**40):
        x = np.array([[rng.randint(-top, top) for _ in range(3)] for _ in range(500)], dtype=np.int64)
        want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
        assert whitening._products(x).tolist() == want


def brute_negatives(rows, positives=5, wanted=3):
    usable = {
        (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * c)) for c in v))
        for i, v, label in rows
        if i is not None and label is not None and v and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)
    }
    out = set()
    for a, own, x in usable:
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, label) for i, label, y in usable if i != a]
        near = sorted({(s, i) for s, i, label in scored if label == own})[:positives]
        for s, i in near:
            inside = sorted({(t, j) for t, j, label in scored if label != own and 50 * -s <= 100 * -t <= 95 * -s})
            out |= {(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(inside[:wanted])}
    return sorted(out)


@pytest.mark.parametrize("cell, block, chunk, first", [(512, 2048, 1024, 4096), (4, 3, 2, 5)])
def test_hard_negatives(spark, monkeypatch, cell, block, chunk, first):
    for name, value in [("CELL_ROWS", cell), ("BLOCK_ROWS", block), ("CHUNK_ANCHORS", chunk), ("FIRST_ROWS", first)]:
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(8)
    rows = [(i, v, rng.randrange(3)) for i, v in enumerate(drawn(260, 4, spread=0.4))]
    common = [0.25, 0.5, -0.125, 0.75]
    rows += [(1000 + i, common, i % 2) for i in range(120)]  # a hot vector, ties, anchors among them
    rows += [rows[50], rows[50], (50, common, 1), (None, common, 1), (77, common, None)]
    rows += [(2000 + k, v, 1) for k, v in enumerate(BAD)]
    got = sorted(map(tuple, negatives.mine(table(spark, rows)).collect()))
    assert got == brute_negatives(rows)
    assert len(got) > 30


def test_hard_negatives_of_little(spark):
    assert negatives.mine(table(spark, [])).count() == 0
    assert negatives.mine(table(spark, [(50, [1.0, 0.0], 1)])).count() == 0
    assert negatives.mine(table(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)])).count() == 0
    zero = [(50, [0.0, 0.0], 1), (51, [0.0, 0.0], 1), (52, [0.0, 0.0], 2)]
    assert [tuple(r) for r in negatives.mine(table(spark, zero)).collect()] == [(50, 51, 1, 52, 0, 0)]


def test_cells_come_by_falling_bound_and_hold_their_rows():
    rng = np.random.default_rng(2)
    points = rng.integers(-100, 100, size=(300, 6)).astype(float)
    centres = [negatives.codebook(points[:, :3], 5), negatives.codebook(points[:, 3:], 5)]
    found = [negatives._nearest(points[:, :3], centres[0]), negatives._nearest(points[:, 3:], centres[1])]
    radii = [np.array([d[c == k].max(initial=0) for k in range(5)]) for c, d in found]
    cell = found[0][0] * 5 + found[1][0]
    cells = negatives.Cells(centres, radii, np.bincount(cell, minlength=25))
    for x in points[:20]:
        listed = list(cells.visit(x))
        assert sorted(c for c, _, _ in listed) == sorted(set(cell.tolist()))
        bounds = [b for _, b, _ in listed]
        assert bounds == sorted(bounds, reverse=True)
        assert all((points[cell == c] @ x).max() <= b for c, b, _ in listed)
