"""Whitening of vectors by the exact spectrum of their integer scatter matrix.

Entries become whole numbers, so counts, sums and sums of products over all rows are exact and do not
depend on how rows are dealt to tasks. Each task reduces its rows to one value per pair of dimensions, Spark
adds these up, and what reaches the driver is one number per pair, whatever the number of rows. The spectrum
comes from ``farelens.llm.spectrum``.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import stored
from farelens.llm.spectrum import Spectrum, leading_spectrum

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
EXACT = 2**53  # sums of whole doubles below are exact


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and all of them finite."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def whole_vectors(
    df: DataFrame, *, id_col: str, vector_col: str, scale: int, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, int]:
    """``(id, x)`` and the columns ``keep`` of the usable rows, ``x`` holding floor(``scale`` * entry), and the
    number of dimensions."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), *keep).where(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), "d").first()
    size = usual["d"] if usual else 0
    x = F.transform("v", lambda c: F.floor(c * scale))
    return rows.where(F.size("v") == size).select("id", x.alias("x"), *keep), size


def as_matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of ``x``, as Python's whole numbers."""
    most = max(int(x.max()), -int(x.min())) if len(x) else 0
    rows = EXACT // max(most * most, 1)
    if rows < 1:
        exact = x.astype(object)
        return exact.T @ exact
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for start in range(0, len(x), rows):
        piece = x[start : start + rows].astype(np.float64)
        total = total + (piece.T @ piece).astype(np.int64).astype(object)
    return total


def moments(vectors: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums and sums of products of ``x`` over all rows of ``vectors``, exact."""
    upper = np.triu_indices(size)

    def run(batches):
        n, sums, products = 0, np.zeros(size, dtype=object), np.zeros((size, size), dtype=object)
        for batch in batches:
            x = as_matrix(batch.column(0), size)
            n += len(x)
            sums = sums + np.array([sum(column) for column in x.T.tolist()], dtype=object)
            products = products + _products(x)
        if n:
            values = [n, *sums.tolist(), *products[upper].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(values)), pa.int32()),
                    pa.array([Decimal(v) for v in values], pa.decimal128(38, 0)),
                ],
                ["place", "value"],
            )

    parts = vectors.select("x").mapInArrow(run, "place int, value decimal(38,0)")
    added = parts.groupBy("place").agg(F.sum("value").alias("value"))
    values = {r["place"]: int(r["value"]) for r in added.collect()}  # one row per pair of dimensions
    if not values:
        return 0, [0] * size, [[0] * size for _ in range(size)]
    products = [[0] * size for _ in range(size)]
    for k, (i, j) in enumerate(zip(*upper)):
        products[i][j] = products[j][i] = values[1 + size + k]
    return values[0], [values[1 + i] for i in range(size)], products


@dataclass
class Whitening:
    n: int
    sums: list[int]
    spectrum: Spectrum  # of n * n * covariance


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of all rows of ``vectors`` (id, x)."""
    n, sums, products = moments(vectors, size)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    return Whitening(n, sums, leading_spectrum(vectors.sparkSession, scatter, components))


def _projected(vectors: DataFrame, size: int, fitted: Whitening) -> DataFrame:
    """``(id, deviation, w)``: squared distance from the mean times n squared, and the whitened components."""
    n, sums = fitted.n, fitted.sums
    # The scatter is n * n * covariance, so its roots are n times the standard deviations.
    weights = fitted.spectrum.vectors / np.sqrt(np.array(fitted.spectrum.eigenvalues, dtype=float))
    n_components = weights.shape[1]

    def run(batches):
        small = np.array(sums, dtype=object)
        most_sum = max((abs(s) for s in sums), default=0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(1), size)
            reach = n * max(int(x.max()), -int(x.min())) + most_sum
            if reach * reach * size < 2**63:
                centred = n * x - small.astype(np.int64)
            else:
                centred = n * x.astype(object) - small
            deviation = [Decimal(int(v)) for v in (centred * centred).sum(axis=1)]
            whitened = centred.astype(np.float64) @ weights
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(deviation, pa.decimal128(38, 0)),
                    pa.FixedSizeListArray.from_arrays(pa.array(whitened.ravel()), n_components).cast(pa.list_(pa.float64())),
                ],
                ["id", "deviation", "w"],
            )

    return vectors.mapInArrow(run, "id long, deviation decimal(38,0), w array<double>")


def _identity_error(projected: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``w``, divisor n, less the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    w = [F.col("w")[i] for i in range(components)]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]
    products = [F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs]
    got = projected.agg(*means, *products).first()
    return max(abs(got[f"p{i}_{j}"] - got[f"m{i}"] * got[f"m{j}"] - (i == j)) for i, j in pairs)


def whiten(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """For each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become floor(1024 * entry) + 100000; the offset changes no result and is left out. All usable
    rows are fitted. ``deviation`` is an exact decimal. Components are numbered from 1 by falling eigenvalue;
    where eigenvalues are equal they are any orthonormal set of the common space, the same for all rows.

    Rows whose vector is NULL, empty, or holds NULL or non-finite entries are dropped, as are vectors of
    another length than most have (the shorter length where two are as frequent). There are as many
    components as positive eigenvalues, at most ``components``: none, so an empty result, for an empty table
    or if all vectors are equal. Repeated rows and rows without an id count each; other columns are ignored.
    """
    vectors, size = whole_vectors(df, id_col=id_col, vector_col=vector_col, scale=SCALE)
    vectors = stored(vectors)
    fitted = fit(vectors, size, components)
    shares = fitted.spectrum.shares
    if not shares:
        empty = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
        return df.sparkSession.createDataFrame([], empty + ", identity_error double")
    projected = stored(_projected(vectors, size, fitted))
    error = _identity_error(projected, len(shares))
    return projected.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
