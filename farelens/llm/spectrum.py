"""Leading eigenvalues and eigenvectors of an integer scatter matrix from its exact characteristic polynomial.

1. Modulo each of enough 31-bit primes, the matrix is brought to Hessenberg form, whose characteristic polynomial
   follows from a recurrence. Primes are rows of a Spark job; each result is one short row.
2. Chinese remaindering gives the exact integer coefficients. A scatter matrix has no negative eigenvalue, so
   they alternate in sign and a bound from the trace says how many primes are enough.
3. All roots are real, so the sign changes of the polynomial shifted by a count the roots above a exactly.
   Halving by this count isolates the wanted roots; a root alone in its interval is then narrowed by sign.
4. Inverse iteration with the root to 60 digits finds the null space of the matrix less the root.

The work of steps 2 to 4 depends on the number of dimensions only, never on the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

EXTRA_BITS = 220  # of a root, below the highest bit of the trace
DIGITS = 90  # of the decimals of inverse iteration
ITERATIONS = 3


def _is_prime(n: int) -> bool:
    """Miller-Rabin; the bases 2, 3, 5 and 7 are enough below 3.2e9."""
    if n < 11 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The greatest primes below 2**31 whose product is above ``bound``."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def _hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``matrix`` modulo ``p`` with zeros below its first subdiagonal."""
    a = matrix.copy()
    size = len(a)
    for j in range(size - 2):
        below = np.flatnonzero(a[j + 1 :, j])
        if not len(below):
            continue
        pivot = j + 1 + below[0]
        if pivot != j + 1:
            a[[j + 1, pivot]] = a[[pivot, j + 1]]
            a[:, [j + 1, pivot]] = a[:, [pivot, j + 1]]
        times = a[j + 2 :, j] * pow(int(a[j + 1, j]), -1, p) % p
        a[j + 2 :] = (a[j + 2 :] - times[:, None] * a[j + 1] % p) % p
        a[:, j + 1] = (a[:, j + 1] + (a[:, j + 2 :] * times % p).sum(axis=1)) % p
    return a


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p``, that of the highest power first."""
    a = _hessenberg(matrix, p)
    size = len(a)
    leading = np.zeros((size + 1, size + 1), dtype=np.int64)  # row k: of the first k rows, lowest power first
    leading[0, 0] = 1
    for k in range(1, size + 1):
        row = np.roll(leading[k - 1], 1)
        row = row - a[k - 1, k - 1] * leading[k - 1] % p
        product = 1
        weights = np.zeros(k - 1, dtype=np.int64)
        for i in range(k - 2, -1, -1):
            product = product * int(a[i + 1, i]) % p
            if not product:
                break
            weights[i] = product * int(a[i, k - 1]) % p
        row = row - (weights[:, None] * leading[: k - 1] % p).sum(axis=0)
        leading[k] = row % p
    return leading[size, ::-1]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x - matrix), highest power first, for a symmetric matrix without negative
    eigenvalues."""
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    # The k-th elementary symmetric function of the roots is largest where all are equal.
    bound = max(comb(size, k) * (trace // k + 1) ** k for k in range(1, size + 1))
    primes = primes_for(bound)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches):
        whole = np.array(shared.value, dtype=object).reshape(size, size)
        for batch in batches:
            for p in batch["p"].tolist():
                found = polynomial_modulo((whole % p).astype(np.int64), p)
                yield pd.DataFrame({"p": [p], "c": [found.tolist()]})

    tasks = min(len(primes), spark.sparkContext.defaultParallelism * 2)
    job = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    rows = {r["p"]: r["c"] for r in job.mapInPandas(run, "p long, c array<long>").collect()}
    product = 1
    for p in primes:
        product *= p
    parts = [(rows[p], product // p * pow(product // p, -1, p)) for p in primes]
    sizes = []
    for k in range(size + 1):
        sign = -1 if k % 2 else 1
        sizes.append(sum(sign * c[k] * unit for c, unit in parts) % product)
    return [-s if k % 2 else s for k, s in enumerate(sizes)]


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots, all real, of the polynomial (highest power first) lie above ``a``, counted as often as
    they are roots: the sign changes of the polynomial moved by ``a``."""
    moved = list(coefficients)
    size = len(moved)
    if a:
        for last in range(size - 1, 0, -1):
            carried = moved[0]
            for k in range(1, last + 1):
                carried = moved[k] = moved[k] + a * carried
    changes, before = 0, 0
    for c in moved:
        if c:
            sign = 1 if c > 0 else -1
            changes += before == -sign
            before = sign
    return changes


def _value_sign(coefficients: list[int], a: int) -> int:
    value = 0
    for c in coefficients:
        value = value * a + c
    return (value > 0) - (value < 0)


def leading_roots(coefficients: list[int], wanted: int, bits: int) -> list[tuple[int, int]]:
    """``(root times 2**bits, rounded up; how often)`` of the greatest positive roots, falling, until
    ``wanted`` of them, counted as often as they are roots, are listed. Roots that agree to ``bits`` bits after
    the point are one."""
    scaled = [c << (bits * k) for k, c in enumerate(coefficients)]
    counted: dict[int, int] = {}

    def above(a: int) -> int:
        if a not in counted:
            counted[a] = roots_above(scaled, a)
        return counted[a]

    top = 1
    while above(top):
        top <<= 1
    positive = above(0)
    found: list[tuple[int, int]] = []
    done = 0
    while done < min(wanted, positive):
        # The root of rank ``done`` is above low and not above high.
        low = max([a for a, n in counted.items() if n > done], default=0)
        high = min([a for a, n in counted.items() if n <= done], default=top)
        while high - low > 1 and above(low) - above(high) > 1:
            middle = (low + high) // 2
            if above(middle) > done:
                low = middle
            else:
                high = middle
        times = above(low) - above(high)
        if times == 1:
            sign = _value_sign(scaled, high)
            if sign:
                while high - low > 1:
                    middle = (low + high) // 2
                    at = _value_sign(scaled, middle)
                    if at == 0:
                        high = middle
                        break
                    if at == sign:
                        high = middle
                    else:
                        low = middle
        found.append((high, times))
        done += times
    return found


def _solver(matrix: np.ndarray, shift: Decimal):
    """A function that solves (matrix - shift) x = b by elimination with pivots."""
    size = len(matrix)
    a = matrix.copy()
    for i in range(size):
        a[i, i] = a[i, i] - shift
    tiny = max(abs(x) for x in matrix.flat).scaleb(-DIGITS + 5) or Decimal(1).scaleb(-DIGITS)
    order = list(range(size))
    for j in range(size):
        pivot = max(range(j, size), key=lambda i: abs(a[i, j]))
        if pivot != j:
            a[[j, pivot]] = a[[pivot, j]]
            order[j], order[pivot] = order[pivot], order[j]
        if abs(a[j, j]) < tiny:
            a[j, j] = tiny
        for i in range(j + 1, size):
            if a[i, j]:
                a[i, j] = a[i, j] / a[j, j]
                a[i, j + 1 :] = a[i, j + 1 :] - a[i, j] * a[j, j + 1 :]

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for i in range(1, size):
            x[i] = x[i] - (a[i, :i] * x[:i]).sum()
        for i in range(size - 1, -1, -1):
            rest = x[i] - (a[i, i + 1 :] * x[i + 1 :]).sum() if i + 1 < size else x[i]
            x[i] = rest / a[i, i]
        return x

    return solve


def _orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
    done: list[np.ndarray] = []
    for v in vectors:
        for _ in range(2):
            for other in done:
                v = v - other * (v * other).sum()
            v = v / (v * v).sum().sqrt()
        done.append(v)
    return done


def null_vectors(matrix: list[list[int]], root: int, bits: int, times: int) -> list[np.ndarray]:
    """``times`` orthonormal eigenvectors, as doubles, of the eigenvalue ``root / 2**bits``."""
    size = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        exact = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object).reshape(size, size)
        solve = _solver(exact, Decimal(root) / Decimal(1 << bits))
        drawn = np.random.default_rng(11).integers(-1000, 1001, size=(times, size))
        vectors = [np.array([Decimal(int(x)) for x in row], dtype=object) for row in drawn]
        for _ in range(ITERATIONS):
            solved = [solve(v) for v in vectors]
            vectors = _orthonormal([v / max(abs(x) for x in v) for v in solved])
        out = [v.astype(float) for v in vectors]
    # Either sign will do: the entry of greatest size is positive.
    return [v if v[np.argmax(np.abs(v))] > 0 else -v for v in out]


@dataclass
class Spectrum:
    coefficients: list[int]
    eigenvalues: list[float]  # falling, as often as they occur
    shares: list[float]  # of the trace
    vectors: np.ndarray  # one column per eigenvalue


def leading_spectrum(spark: SparkSession, matrix: list[list[int]], wanted: int) -> Spectrum:
    """The ``wanted`` greatest positive eigenvalues of a scatter matrix of whole numbers, with unit eigenvectors."""
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    if not trace:
        return Spectrum([1] + [0] * size, [], [], np.zeros((size, 0)))
    coefficients = characteristic_polynomial(spark, matrix)
    bits = max(EXTRA_BITS - trace.bit_length(), 8)
    values, shares, vectors = [], [], []
    for root, times in leading_roots(coefficients, wanted, bits):
        for vector in null_vectors(matrix, root, bits, times):
            values.append(root / (1 << bits))  # Python rounds the quotient of whole numbers correctly
            shares.append(root / (trace << bits))
            vectors.append(vector)
    chosen = slice(0, wanted)
    return Spectrum(coefficients, values[chosen], shares[chosen], np.array(vectors[chosen]).reshape(-1, size).T)
