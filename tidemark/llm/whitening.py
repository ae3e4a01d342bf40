"""Whitening of vectors by QDWH spectral divide and conquer.

The covariance is summed exactly, in whole numbers: rows are centred on the
whole part of the mean before they are multiplied, and what the fraction adds is
taken off in integers. The fit covers each distinct vector once.

The eigenvectors of the covariance come from polar decompositions. For a shift s
inside the spectrum, the polar factor U of V - sI gives the projector (U + I)/2
on the invariant subspace above s; a basis of it and one of its complement split
the problem in two, down to single components. U is computed by the dynamically
weighted Halley iteration in its inverse-free form (QR factorisations), which
takes six steps for any matrix. Shifts are tried until the off-diagonal block of
the split vanishes to rounding.

The components, a matrix of fixed size, go to the tasks, which project the rows.
The driver gets sums over the table, one per pair of dimensions.

Defined results: rows whose vector is null or has null or non-finite entries are
dropped; every other row is whitened, repeated rows and rows with a null or
repeated ``vec_id`` too. Components of no variance (beyond rounding) cannot be
whitened and give no rows, so a table with one distinct vector gives none, as
does an empty one. ``deviation`` is null where it exceeds 64 bits. Extra columns
are ignored. Vectors of different widths, or with entries above 2**31 in size
after scaling, are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .vectors import matrix, measure, whole

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
_EPS = np.finfo(float).eps


# --- spectral divide and conquer -----------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    n = len(a)
    x, low = a / np.linalg.norm(a), 1e-16
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * (basis[:n] @ basis[n:].T)
        new = (new + new.T) / 2
        step, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        if step <= np.cbrt(4 * _EPS) and 1 - low < 8 * _EPS:
            break
    return x


def _split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int, float] | None:
    """(orthogonal basis, dimensions above the shift, norm of the off-diagonal block)."""
    n = len(a)
    moved = a - shift * np.eye(n)
    if not np.linalg.norm(moved):
        return None
    upper = (polar_factor(moved) + np.eye(n)) / 2
    rank = int(round(np.trace(upper)))
    if not 0 < rank < n:
        return None
    basis = np.linalg.qr(upper @ rng.standard_normal((n, rank)))[0]
    basis = np.linalg.qr(upper @ basis)[0]
    basis = np.linalg.qr(np.hstack([basis, rng.standard_normal((n, n - rank))]))[0]
    return basis, rank, float(np.linalg.norm(basis[:, :rank].T @ a @ basis[:, rank:]))


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    size, rng = np.linalg.norm(matrix), np.random.default_rng(20240807)
    values, vectors = [], []
    todo = [(matrix, np.eye(len(matrix)))]
    while todo:
        a, basis = todo.pop()
        n = len(a)
        mean = np.trace(a) / n
        spread = np.linalg.norm(a - mean * np.eye(n))
        if n == 1 or spread <= 2 * n * _EPS * size:
            values += np.diag(a).tolist()
            vectors += list(basis.T)
            continue
        # The mean of the spectrum lies inside it; others help if an eigenvalue is too near.
        steps = spread / np.sqrt(n) * np.array([0, 0.31, -0.31, 0.083, -0.083, 0.017, -0.017, 0.0041, -0.0041])
        best = None
        for shift in [np.median(np.diag(a)), *(mean + steps)]:
            got = _split(a, shift, rng)
            if got and (best is None or got[2] < best[2]):
                best = got
            if best and best[2] <= 8 * n * _EPS * size:
                break
        if best is None or best[2] > 1e-10 * size:
            raise ArithmeticError("no shift splits the spectrum")
        turn, rank, _ = best
        for part in (turn[:, :rank], turn[:, rank:]):
            inner = part.T @ a @ part
            todo.append(((inner + inner.T) / 2, basis @ part))
    order = np.argsort(values)[::-1]
    vectors = np.array(vectors).reshape(len(order), -1)[order].T
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    heads = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return np.array(values)[order], vectors * np.where(heads < 0, -1, 1)


# --- exact sums ------------------------------------------------------------


def _totals(rows: DataFrame, width: int, cells: int, add: Callable[[np.ndarray], np.ndarray], bound: int) -> list[int]:
    """Exact sums over all rows of the whole numbers ``add`` makes of a block; ``bound`` holds for one row's.

    A task sends one row per cell, a number cut in two so that sums stay in 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, inner, seen = np.zeros(cells, object), np.zeros(cells, np.int64), 0
        for rows in batches:
            x = matrix(rows.column("x"), width)
            for at in range(0, len(x), 1024):
                block = x[at : at + 1024]
                if (seen + len(block)) * bound >= 1 << 62:
                    total, inner, seen = total + inner.astype(object), np.zeros(cells, np.int64), 0
                if len(block) * bound >= 1 << 62:
                    total = total + np.asarray(add(block.astype(object)), object).ravel()
                else:
                    inner, seen = inner + np.asarray(add(block)).ravel().astype(np.int64), seen + len(block)
        total = total + inner.astype(object)
        used = [i for i, v in enumerate(total) if v]
        if used:
            high, low = [int(total[i]) >> 32 for i in used], [int(total[i]) & 0xFFFFFFFF for i in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["cell", "high", "low"])

    sums = [0] * cells
    parts = rows.select("x").mapInArrow(run, "cell bigint, high bigint, low bigint")
    for r in parts.groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # one row a cell
        sums[r["cell"]] = (r["high"] << 32) + r["low"]
    return sums


def products(z: np.ndarray, bound: int) -> np.ndarray:
    """z'z, exactly: by a matrix product of doubles where they hold every sum."""
    if z.dtype != object and len(z) * bound * bound < 1 << 53:
        wide = z.astype(float)
        return (wide.T @ wide).astype(np.int64)
    return z.T @ z


class Fit:
    """What tasks need to whiten: n, the means as whole part and remainder, and the scaled components."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, low: int, high: int, components: int):
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.reach = max(high - min(self.base.tolist()), max(self.base.tolist()) - low) + 1
        values, vectors = eigen(covariance)
        rank = int((values > len(values) * _EPS * max(values[0], 0)).sum())
        self.values, self.vectors = values[: min(rank, components)], vectors[:, : min(rank, components)]
        self.explained = self.values / np.trace(covariance) if len(self.values) else self.values

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        z = x - self.base
        if len(self.base) * (self.n * self.reach) ** 2 < 1 << 63:
            return ((self.n * z - self.rest) ** 2).sum(axis=1).tolist()
        if len(self.base) * self.reach * max(self.reach, self.n) >= 1 << 63:
            z = z.astype(object)
        squares, mixed, rest = (z * z).sum(axis=1), (z * self.rest).sum(axis=1), sum(int(r) ** 2 for r in self.rest)
        exact = (self.n**2 * int(a) - 2 * self.n * int(b) + rest for a, b in zip(squares, mixed, strict=True))
        return [v if v < 1 << 63 else None for v in exact]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base) - self.rest / self.n) @ self.vectors / np.sqrt(self.values)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Means, exact covariance and its components over a table of distinct vectors ``x``."""
    n, width, low, high = measure(distinct)
    if not n or not width:
        return None
    sums = _totals(distinct, width, width, lambda x: x.sum(axis=0), max(abs(low), abs(high), 1))
    base = [s // n for s in sums]
    means, reach = np.array(base, np.int64), max(high - min(base), max(base) - low) + 1
    upper = np.triu_indices(width)
    moments = _totals(distinct, width, len(upper[0]), lambda x: products(x - means, reach)[upper], reach * reach)
    covariance = np.zeros((width, width))
    rest = [s % n for s in sums]
    for i, j, m in zip(*(u.tolist() for u in upper), moments, strict=True):
        covariance[i, j] = covariance[j, i] = (n * m - rest[i] * rest[j]) / n**2
    return Fit(n, sums, covariance, low, high, components)


def identity_error(distinct: DataFrame, known: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over the table."""
    count, width = len(known.values), len(known.base)
    if not count:
        return 0.0
    sent = distinct.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count))
        for rows in batches:
            white = sent.value.whiten(matrix(rows.column("x"), width))
            total += np.vstack([white.sum(axis=0), white.T @ white])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["cell", "part"])

    cells = distinct.select("x").mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part"))
    total = np.array([v for _, v in sorted(map(tuple, cells.collect()))]).reshape(count + 1, count) / known.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(count)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component."""
    rows = whole(vectors, SCALE, SHIFT, F.col("vec_id").cast("bigint").alias("vec_id"))
    distinct = materialize(rows.select("x").distinct())
    known = fit(distinct, components)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if known is None or not len(known.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, count, width = identity_error(distinct, known), len(known.values), len(known.base)
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for rows in batches:
            for at in range(0, rows.num_rows, 2048):
                block = rows.slice(at, 2048)
                x, n = matrix(block.column("x"), width), block.num_rows
                every = pa.array(np.repeat(np.arange(n), count))
                columns = [
                    block.column("vec_id").take(every),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * count, fitted.n)),
                    pa.array(fitted.deviations(x), pa.int64()).take(every),
                    pa.array(fitted.whiten(x).ravel()),
                    pa.array(np.tile(fitted.explained, n)),
                    pa.array(np.full(n * count, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
