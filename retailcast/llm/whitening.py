"""Embedding whitening; the leading eigenvectors come from contour integration (FEAST).

Vectors are fixed-point numbers, so counts, sums and deviations are exact integers. Sums and centred products are
added up partition by partition, and only the covariance, whose size is that of a vector, reaches the driver.

The eigenvectors of an eigenvalue interval are found from shifted complex solves ``(zI - V) X = Y`` at the points of
a circle around the interval: their weighted sum projects ``Y`` onto the wanted subspace, Rayleigh-Ritz extracts
vectors from it, and they are the next ``Y``. The interval is placed by inertia counts (signs of the pivots
of a factorisation of ``V - shift I``), and the pairs found must be as many as the count says.

Defined cases: rows whose vector is null, holds a null or non-finite entry, or an entry beyond 2^43 in size (no exact
fixed-point number) are left out, and so are vectors of another length than most have (ties: the longer). A deviation
beyond 64 bits is null. Components whose eigenvalue is under 1e-11 of the trace are not components, so a table
of one vector, repeated or not, and an empty table give no rows. Repeated rows and rows without a key are rows like any other; equal
eigenvalues give any orthonormal basis of their space. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import partition_sums, stored

SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0**43  # entries up to here are whole numbers of a double after scaling
WORD = 1 << 20  # sums travel as high and low parts, each exact in a double
POINTS = 8  # of the upper half of the contour
FLOOR = 1e-11  # of the trace
WIDTH = 1e-10  # of the trace; eigenvalues closer than this are not told apart by the interval


class Inertia:
    """Counts the eigenvalues of a symmetric matrix above a shift: the positive pivots of ``LDL'`` of the shifted matrix.

    The matrix is brought to tridiagonal form once (Householder), so that a count is one pass over its diagonal.
    """

    def __init__(self, matrix: np.ndarray):
        a, d = np.array(matrix, np.float64), len(matrix)
        off = np.zeros(max(d - 1, 0))
        for i in range(d - 1):
            x = a[i + 1 :, i].copy()
            off[i] = -np.copysign(np.linalg.norm(x), x[0])
            x[0] -= off[i]
            size = np.linalg.norm(x)
            if size > 0:
                x /= size
                rest = a[i + 1 :, i + 1 :]
                y = rest @ x
                y -= (x @ y) * x
                rest -= 2 * (np.outer(x, y) + np.outer(y, x))
        self.diagonal, self.squares = np.diag(a).tolist(), [0.0, *(off**2).tolist()]

    def above(self, shift: float) -> int:
        pivot, count = 1.0, 0
        for entry, square in zip(self.diagonal, self.squares, strict=True):
            pivot = entry - shift - square / pivot
            if abs(pivot) < 1e-300:
                pivot = -1e-300
            count += pivot > 0
        return count


def _cut(inertia: Inertia, low: float, high: float, wanted: int, steps: int = 60) -> tuple[float, float]:
    """The last bracket with at least ``wanted`` eigenvalues above its low end and fewer above its high end."""
    for _ in range(steps):
        if high - low <= WIDTH:
            break
        middle = (low + high) / 2
        low, high = (middle, high) if inertia.above(middle) >= wanted else (low, middle)
    return low, high


def interval(inertia: Inertia, d: int, k: int) -> tuple[float, float, int]:
    """Ends and inertia count of an interval that holds the ``k`` largest eigenvalues of a matrix of size ``d`` and trace 1.

    The low end lies in the middle of the gap below the k-th eigenvalue. Where there is no gap, it lies under all
    eigenvalues that equal the k-th, so the count may exceed ``k``.
    """
    bound = 1 + 1e-6  # the trace is 1 and no eigenvalue is negative
    kth, _ = _cut(inertia, -1e-6, bound, k)
    _, top = _cut(inertia, kth, bound, 1)
    low = kth - WIDTH
    if d > k:
        below, _ = _cut(inertia, -1e-6, bound, k + 1)
        low = min(low, (below + kth) / 2)
    else:
        low = min(low, kth / 2)
    return low, top + WIDTH, inertia.above(low) - inertia.above(top + WIDTH)


def _projected(matrix: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """Quadrature of the resolvent along a circle through the ends of the interval, applied to a block."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros(block.shape)
    for j in range(POINTS):
        turn = radius * np.exp(1j * np.pi * (j + 0.5) / POINTS)
        out += (turn * np.linalg.solve((centre + turn) * np.eye(len(matrix)) - matrix, block.astype(complex))).real
    return out / POINTS


def leading(covariance: np.ndarray, k: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their unit vectors (columns) of a covariance, fewer if its rank is lower."""
    trace = float(np.trace(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    matrix = (covariance + covariance.T) / (2 * trace)
    inertia = Inertia(matrix)
    k = min(k, inertia.above(FLOOR))
    low, high, count = interval(inertia, len(matrix), k)
    for size in (min(len(matrix), count + max(8, count)), len(matrix)):  # the whole space is exact
        block = np.random.default_rng(7).standard_normal((len(matrix), size))
        for _ in range(rounds):
            basis, _ = np.linalg.qr(_projected(matrix, block, low, high))
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turn
            inside = (values > low) & (values < high)
            rest = np.linalg.norm(matrix @ block - block * values, axis=0)[inside]
            if inside.sum() == count and rest.max(initial=0) <= 1e-14:
                order = np.argsort(-values[inside], kind="stable")[:k]
                return values[inside][order] * trace, block[:, inside][:, order]
    raise ArithmeticError(f"the contour holds {count} eigenvalues, but {int(inside.sum())} were extracted")


def fixed_point(vectors: pd.Series) -> np.ndarray:
    """One row of integers for each vector."""
    return np.floor(SCALE * np.stack(vectors.to_numpy()).astype(np.float64)).astype(np.int64) + OFFSET


def exact_centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` in whole numbers; Python's own where 64 bits may not hold them."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(centred: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None beyond 64 bits."""
    if (centred.astype(np.float64) ** 2).sum(1).max(initial=0) < 2.0**62:
        return (centred * centred).sum(1).tolist()
    return [total if total < 1 << 63 else None for total in (centred.astype(object) ** 2).sum(1)]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is whole, finite and of the usual length."""
    numbers = F.col(f"`{vector}`").cast("array<double>")
    whole = numbers.isNotNull() & F.forall(numbers, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= LARGEST))
    rows = df.where(whole & (F.size(numbers) > 0))
    sizes = rows.groupBy(F.size(numbers).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size(numbers) == F.lit(sizes["d"] if sizes else -1))


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]  # by dimension
    trace: float
    values: np.ndarray  # eigenvalues, falling
    basis: np.ndarray  # unit vectors as columns

    def apply(self, vector: Column) -> Column:
        """``deviation`` and ``whitened`` (one number a component) of each vector."""
        n, sums, map_ = self.n, self.sums, self.basis / np.sqrt(self.values)

        @F.pandas_udf("deviation long, whitened array<double>")
        def run(vectors: pd.Series) -> pd.DataFrame:
            if not len(vectors):
                return pd.DataFrame({"deviation": pd.Series([], dtype="Int64"), "whitened": []})
            centred = exact_centre(fixed_point(vectors), n, sums)
            out = (centred / n).astype(np.float64) @ map_
            return pd.DataFrame({"deviation": pd.array(squares(centred), "Int64"), "whitened": list(out)})

        return run(vector)


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening:
    """Covariance over all given rows (see ``usable``) and its leading components."""
    vectors = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def totals(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
        n, high, low = 0, 0, 0
        for pdf in batches:
            if len(pdf):
                x = fixed_point(pdf["v"])
                n, high, low = n + len(x), high + (x // WORD).sum(0), low + (x % WORD).sum(0)
        return {"n": np.array([n]), "high": high, "low": low} if n else {}

    found = partition_sums(vectors, totals)
    if not found:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    n = int(found["n"][0])
    sums = [int(h) * WORD + int(v) for h, v in zip(found["high"], found["low"], strict=True)]

    def products(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
        total = np.zeros((len(sums), len(sums)))
        for pdf in batches:
            if len(pdf):
                x = (exact_centre(fixed_point(pdf["v"]), n, sums) / n).astype(np.float64)
                total += x.T @ x
        return {"products": total}

    covariance = partition_sums(vectors, products)["products"] / n
    values, basis = leading(covariance, components)
    return Whitening(n, sums, float(np.trace(covariance)), values, basis)


def identity_error(rows: DataFrame) -> float:
    """Largest entry of the covariance of a column ``whitened`` minus the identity, centred before multiplying."""

    def totals(batches):
        parts = [np.stack(pdf["whitened"].to_numpy()) for pdf in batches if len(pdf)]
        return {"n": np.array([sum(map(len, parts))]), "sum": sum(p.sum(0) for p in parts)} if parts else {}

    found = partition_sums(rows.select("whitened"), totals)
    n, mean = found["n"][0], found["sum"] / found["n"][0]

    def products(batches):
        total = np.zeros((len(mean), len(mean)))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["whitened"].to_numpy()) - mean
                total += x.T @ x
        return {"products": total}

    return float(np.abs(partition_sums(rows.select("whitened"), products)["products"] / n - np.eye(len(mean))).max())


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """One row for each usable vector and component, with the figures of the fit."""
    rows = usable(df, vector)
    model = fit(rows, vector, components)
    if not len(model.values):
        return df.sparkSession.createDataFrame(
            [],
            f"`{key}` {dict(df.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double",
        )
    done = model.apply(F.col(f"`{vector}`").cast("array<double>"))
    done = stored(rows.select(F.col(f"`{key}`").alias("key"), done.alias("w")).select("key", "w.*"), "whitened")
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    flat = done.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(
        F.col("key").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(identity_error(done)).alias("identity_error"),
    )
