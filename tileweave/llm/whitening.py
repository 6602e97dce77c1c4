"""Whitening of embedding vectors (operator 11).

Entries become whole numbers first, so that equal vectors are told exactly and sums are
exact.  The model is fitted on the fit list, each distinct vector once: sums per
dimension, then the centred scatter, one small matrix of a task each.  The scatter is
factored by a Cholesky decomposition that takes the largest remaining pivot first;
one-sided Jacobi rotations make the columns of the triangular factor orthogonal, and
then their squared norms are the eigenvalues and the normalised columns the components,
without the scatter's small eigenvalues ever being formed from large ones.

Only matrices of the vectors' dimensions reach the driver, never vectors.

Defined results: a vector that is null, or holds a null or non-finite entry, is dropped.
Numbers beyond the range of a long count as the nearest long.  The model's dimension is
the length that most of the distinct vectors have (the longest of ties); vectors of other lengths
can't be projected and are dropped, too.  A component without variance isn't one, so a fit list
of rank r has r components at most, and an empty one or one of equal vectors has none; then there
are no rows per component.  Repeated rows get equal results; equal eigenvalues keep the order of
the factor's columns.  A deviation that no long holds is null.  Extra columns pass
through ``with_whitened``, whatever their names, unless they carry a result's name, in which
case the result replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_results

SCALE, COMPONENTS = 256, 4
#: Sweeps of rotations, at most (some ten are needed).
SWEEPS = 60
_LONG = 1 << 63


@dataclass
class Whitening:
    """Count and exact sums of the fit list, and its components (rows) with their eigenvalues, falling."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def first(self, k: int) -> int:
        return min(k, len(self.eigenvalues))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) - np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        k = self.first(k)
        return self.centred(x) @ self.components[:k].T / np.sqrt(self.eigenvalues[:k])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - S)^2; nothing where no long holds one."""
        sums = np.array(self.sums, dtype=object)
        most = max((max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0) * self.n + max(map(abs, self.sums), default=0), 1)
        if most * most * max(self.dims, 1) < _LONG:
            off = x * self.n - sums.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(axis=1)
        return [int(v) if v < _LONG else None for v in exact]


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Whole numbers of a vector's entries; null for a vector that is null or holds a null or non-finite entry."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    number = vector.cast("array<double>")
    return F.when(F.forall(number, finite), F.transform(number, lambda c: F.floor(c * float(scale)) + F.lit(0).cast("long")))


def fit_list(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Each distinct vector of ``df`` once; null isn't one."""
    return df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("x")).distinct()


def _stacked(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of the vectors of most frequent length, and their exact sums."""
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0].d:
        return 0, []
    dims, n = lengths[0].d, lengths[0].n

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # halves of the numbers, so that no sum of a batch overflows
            x = _stacked(batch.column(0), dims)
            if len(x):
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(dims)), "high": pa.array((x >> 32).sum(axis=0)), "low": pa.array((x & 0xFFFFFFFF).sum(axis=0))})

    halves = fit.where(F.size("x") == dims).mapInArrow(added, "at long, high long, low long").groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")])
    sums = {row.at: (int(row.high) << 32) + int(row.low) for row in halves.collect()}  # a row for each dimension
    return n, [sums[i] for i in range(dims)]


def _matrix(parts: DataFrame, dims: int) -> np.ndarray:
    """The sum of the matrices that tasks have made, a row of one in each row of ``parts`` (at, row)."""
    entries = parts.select("at", F.posexplode("row").alias("to", "v")).groupBy("at", "to").agg(F.sum("v").alias("v"))
    total = np.zeros((dims, dims))
    for row in entries.collect():  # dims x dims numbers
        total[row["at"], row["to"]] = row["v"]
    return total


def _products(fit: DataFrame, dims: int, projected) -> DataFrame:
    """at, row: the sum of the outer products of ``projected(x)`` over the vectors of each task."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0.0, False
        for batch in batches:
            y = projected(_stacked(batch.column(0), dims))
            if len(y):
                total, seen = total + y.T @ y, True
        if seen:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total))), "row": pa.array(list(total), pa.list_(pa.float64()))})

    return fit.where(F.size("x") == dims).mapInArrow(added, "at long, row array<double>")


def pivoted_cholesky(a: np.ndarray, tolerance: float = 1e-14) -> np.ndarray:
    """L of rank columns with L L' = ``a`` (symmetric, positive semidefinite), the largest remaining pivot first.

    Rows keep ``a``'s order: they are the triangular factor's, put back.  Pivots under
    ``tolerance`` of the first one are rounding and end the factor.
    """
    left = np.array(a, dtype=np.float64)
    size = len(left)
    order, columns = [], []
    open_rows = np.ones(size, bool)
    first = left.diagonal().max(initial=0.0)
    for _ in range(size):
        diagonal = np.where(open_rows, left.diagonal(), -np.inf)
        p = int(diagonal.argmax())
        if diagonal[p] <= first * tolerance or diagonal[p] <= 0:
            break
        column = np.where(open_rows, left[:, p], 0.0) / np.sqrt(left[p, p])
        left -= np.outer(column, column)
        columns.append(column)
        order.append(p)
        open_rows[p] = False
    return np.array(columns).T if columns else np.zeros((size, 0))


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of pairs that share no column (a round-robin tournament)."""
    seats = list(range(n + n % 2))
    rounds = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        met = [(min(i, j), max(i, j)) for i, j in zip(seats[:half], reversed(seats[half:])) if max(i, j) < n]
        rounds.append((np.array([i for i, _ in met], int), np.array([j for _, j in met], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, falling, and normalised columns (as rows) of ``factor`` once rotations have made its columns orthogonal."""
    g = np.array(factor, dtype=np.float64)
    rounds = rounds_of_pairs(g.shape[1]) if g.shape[1] > 1 else []
    orthogonal = np.finfo(np.float64).eps * max(8, len(g))  # a cosine of rounding alone
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in rounds:
            a, b = g[:, i], g[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            cosine = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > orthogonal / 8
            zeta = (bb - aa) / np.where(turn, 2 * ab, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            g[:, i], g[:, j] = c * a - s * b, s * a + c * b
        if worst <= orthogonal:
            break
    square = (g * g).sum(axis=0)
    order = np.argsort(-square, kind="stable")
    return square[order], (g[:, order] / np.sqrt(square[order])).T


def fit_whitening(fit: DataFrame) -> Whitening:
    """The model of a fit list, a table with a row for each distinct vector ``x``."""
    n, sums = _sums(fit)
    if not n:
        return Whitening(0, [], np.empty(0), np.empty((0, 0)), 0.0)
    empty = Whitening(n, sums, np.empty(0), np.empty((0, len(sums))), 0.0)
    covariance = _matrix(_products(fit, len(sums), empty.centred), len(sums)) / n
    eigenvalues, components = one_sided_jacobi(pivoted_cholesky(covariance))
    return Whitening(n, sums, eigenvalues, components, float(np.trace(covariance)))


def identity_error(fit: DataFrame, model: Whitening, k: int = COMPONENTS) -> float:
    """Largest absolute entry of the covariance of the fit list's whitened vectors minus the identity."""
    if not (k := model.first(k)):
        return 0.0
    # A column of ones beside them: its products are the sums, which centre the others'.
    ones = lambda x: np.column_stack([model.whitened(x, k), np.ones(len(x))])
    total = _matrix(_products(fit, model.dims, ones), k + 1) / model.n
    mean = total[:k, k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def with_whitened(df: DataFrame, model: Whitening, vector: str = "vector", k: int = COMPONENTS) -> DataFrame:
    """Rows of ``df`` whose vector the model projects, with ``whitened`` (an entry a component) and ``deviation``."""
    dims = model.dims

    @F.pandas_udf("whitened array<double>, deviation long")
    def projected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.to_list()).astype(np.int64, copy=False) if len(batch) else np.empty((0, dims), np.int64)
            yield pd.DataFrame({"whitened": list(model.whitened(x, k)), "deviation": pd.array(model.deviations(x), dtype="Int64")})

    fits = df.where(F.size(F.col(vector)) == dims) if model.n else df.limit(0)
    return with_results(fits, projected(F.col(vector)), ["whitened", "deviation"])
