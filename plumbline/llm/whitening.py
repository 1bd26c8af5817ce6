"""Embedding whitening by shifted CholeskyQR.

Vectors are put on an integer grid, and each distinct grid vector counts once: the fit list. Centred by exact integer
sums, its rows form a matrix A that stays distributed. A pass adds up the Gram matrix of the rows in every task; its
Cholesky factor R, of a matrix shifted by a multiple of the rounding error where needed, makes the next pass's rows more
orthogonal through triangular solves. The factors are composed, the last Gram matrix closes what is left of them, and
the singular values and right vectors of the composed factor are those of A: eigenvalues and eigenvectors of the
covariance, without its squared condition number. Two or three passes are enough unless columns depend on each other.

Only sums of fixed size (a d x d matrix for d dimensions) reach the driver; rows stay in tables.

Edge cases: vectors that are null or hold null or non-finite entries, or entries beyond 2 ** 52 on the grid, are left
out. If lengths differ, the length with the most distinct vectors is whitened (ties: the longer), others are left out.
Components whose variance is zero, up to rounding, do not exist: constant and dependent dimensions lower the number of
components, and equal vectors alone give none, so no rows. A deviation that no long holds is null. Null and repeated
vec_ids are rows like any other. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

SCALE, COMPONENTS = 64, 16
GRID_LIMIT = 2.0**52
ROWS_AT_ONCE = 4_096
MOST_PASSES = 12
LEAST_VARIANCE = 1e-20  # of a component, as a share of the largest one's


def _vectors(table: DataFrame) -> DataFrame:
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def grid_rows(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their vectors ``floor(scale * c)``, by length; rows left out are missing."""
    lists = batch.column("embedding")
    length = np.asarray(pc.fill_null(pc.list_value_length(lists), -1), dtype=np.int64)
    flat = np.asarray(pc.fill_null(pc.list_flatten(lists), np.nan), dtype=np.float64)
    some = np.maximum(length, 0)
    with np.errstate(invalid="ignore", over="ignore"):
        value = np.floor(flat * scale)
        wrong = ~(np.abs(value) < GRID_LIMIT)
    fine = (length >= 0) & (np.bincount(np.repeat(np.arange(len(length)), some), weights=wrong, minlength=len(length)) == 0)
    first = np.cumsum(some) - some
    for d in np.unique(length[fine]):
        rows = np.flatnonzero(fine & (length == d))
        for part in np.array_split(rows, max(1, -(-len(rows) // ROWS_AT_ONCE))):
            yield part, value[first[part][:, None] + np.arange(d)].astype(np.int64)


def fit_list(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(dims, grid) of each distinct grid vector; ``grid`` holds little-endian longs. Written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, grid in grid_rows(batch, scale):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grid), grid.shape[1], dtype=np.int32)), pa.array([g.tobytes() for g in grid], pa.binary())], names=["dims", "grid"])

    return shared.written(_vectors(vectors).mapInArrow(run, "dims int, grid binary").distinct())


def _grids(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.column("grid").slice(begin, ROWS_AT_ONCE)
            yield np.frombuffer(b"".join(x.as_buffer() for x in rows), dtype=np.int64).reshape(-1, d)


def triangular_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows @ inverse(r)`` for an upper triangular ``r``, by substitution."""
    out = np.empty_like(rows)
    for j in range(r.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


@dataclass
class Whitening:
    """Mean (exact, as n and sums), variances and unit directions by falling variance, and their trace."""

    dims: int
    n: int
    sums: list[int]  # of the grid vectors, per dimension
    variance: np.ndarray
    direction: np.ndarray
    trace: float
    passes: int = 0

    def scaled(self, grid: np.ndarray) -> np.ndarray:
        """``n * x - sum`` as exact integers: longs where they fit, Python integers where they may not."""
        largest = float(np.abs(grid).max(initial=0)) * self.n + max((abs(s) for s in self.sums), default=0)
        kind = np.int64 if largest < 2.0**62 else object
        return grid.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def centred(self, grid: np.ndarray) -> np.ndarray:
        return (self.scaled(grid) / self.n).astype(np.float64)

    def deviations(self, grid: np.ndarray) -> list[int | None]:
        scaled = self.scaled(grid)
        if self.dims * float(np.abs(scaled).max(initial=0)) ** 2 < 2.0**62:
            return (scaled * scaled).sum(axis=1).tolist()
        exact = (scaled.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, grid: np.ndarray) -> np.ndarray:
        return self.centred(grid) @ self.direction / np.sqrt(self.variance)


def _added(parts: DataFrame) -> list:
    """Sums of (i, j, v) rows of all tasks; as many as the matrix has cells, whatever the input."""
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()


def _upper(total: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(total))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])


def gram(fit: DataFrame, of, d: int, width: int) -> np.ndarray:
    """Gram matrix of the rows that ``of`` makes of the grid vectors, added up in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for grid in _grids(batches, d):
            rows = of(grid)
            total += rows.T @ rows
        yield _upper(total)

    out = np.zeros((width, width))
    for row in _added(fit.mapInArrow(run, "i int, j int, v double")):
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


def _exact_sums(fit: DataFrame, d: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for grid in _grids(batches, d):  # at most ROWS_AT_ONCE * 2 ** 52: a long holds it
            total = [a + b for a, b in zip(total, grid.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([0] * d, pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "j", "v"])

    return [int(row["v"]) for row in sorted(_added(fit.mapInArrow(run, "i int, j int, v decimal(38,0)")), key=lambda r: r["i"])]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list (see ``fit_list``); None if it is empty."""
    lengths = fit.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None or lengths["dims"] == 0:
        return None
    d, n = lengths["dims"], lengths["n"]
    rows = fit.where(F.col("dims") == d).select("grid")
    model = Whitening(d, n, _exact_sums(rows, d), np.empty(0), np.empty((d, 0)), 0.0)
    factors: list[np.ndarray] = []

    def orthogonalised(grid: np.ndarray) -> np.ndarray:
        a = model.centred(grid)
        for r in factors:
            a = triangular_solve(a, r)
        return a

    composed = np.eye(d)
    while True:
        g = gram(rows, orthogonalised, d, d)
        model.passes += 1
        size = float(np.trace(g))
        if not factors:
            model.trace = size / n
            if size == 0:
                return model
        values, vectors = np.linalg.eigh(g)
        if factors and (np.minimum(np.abs(values - 1), np.abs(values)) <= 1e-6).all() or model.passes == MOST_PASSES:
            break
        if not factors or values[0] <= 1e-10:  # keeps the factor regular whatever the rows' rank
            g = g + np.eye(d) * (11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * size)
        r = np.linalg.cholesky(g).T
        factors.append(r)
        composed = r @ composed
    # rows = Q @ composed with Q'Q = g, so the rest of Q's length goes into the factor; directions without rows are 0
    rest = np.sqrt(np.where(values > 1e-6, values, 0.0))[:, None] * vectors.T
    _, singular, right = np.linalg.svd(rest @ composed)
    variance = singular**2 / n
    real = (variance > LEAST_VARIANCE * variance[0])[:components]
    model.variance, model.direction = variance[:components][real], right[:components][real].T
    model.trace = float(variance.sum())
    return model


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.variance)
    rows = fit.where(F.col("dims") == model.dims).select("grid")
    with_one = gram(rows, lambda grid: np.column_stack([model.whitened(grid), np.ones(len(grid))]), model.dims, k + 1) / model.n
    mean = with_one[:k, k]  # rows are centred before they are multiplied: only the rounding of the mean is left
    return float(np.abs(with_one[:k, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per remaining row and component."""
    fit = fit_list(vectors, scale)
    model = fit_whitening(fit, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variance):
        return vectors.sparkSession.createDataFrame([], schema)
    k, error, explained = len(model.variance), identity_error(fit, model), model.variance / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for rows, grid in grid_rows(batch, scale):
                if grid.shape[1] != model.dims:
                    continue
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                     pa.array(model.deviations(grid), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.whitened(grid).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _vectors(vectors).mapInArrow(run, schema)
