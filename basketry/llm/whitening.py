r"""Embedding whitening: a pivoted Cholesky factor of the centred scatter, then
one-sided Jacobi rotations on the factor itself.

Vectors become whole numbers x = floor(256 c). The model is fitted on each
distinct x once: every task keeps the count, the mean and the scatter about its
own mean of the vectors it reads (numbers are centred before they are
multiplied), and Spark adds these up with the term between the tasks. Sums of
x are whole numbers and exact. The scatter A = P L L' P', a table of width x width numbers,
is factored on the driver; the columns of L are rotated in pairs until all are
orthogonal. Then their squared norms are the eigenvalues of A and the columns,
divided by their norms, its unit eigenvectors: A itself is never rotated, so
small eigenvalues keep their digits. Columns stop at the numerical rank.

Memory: a task holds one width x width table and a batch of rows; the driver one
such table. Distinct vectors are found by a shuffle that folds copies before it
moves them, so a vector that a third of all rows hold costs one row per task.

Defined results: rows whose vector is null or holds null, NaN or infinite
entries go; a shorter vector is filled up with zeros to the longest (empty ones
too); entries beyond 64-bit whole numbers saturate; repeated rows give their
rows each and count once in the fit; equal eigenvalues come in the order of the
rotated columns; a component without variance is left out, so one distinct
vector, vectors without entries or an empty table give no rows; a deviation beyond 64 bits is
null. Each component's largest entry is positive. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

#: Whole numbers of one entry unit.
SCALE = 256
_PARTS = "dim int, n long, total decimal(38,0), own double, means array<double>, scatter array<double>"


def _usable(vector: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda v: finite(v.cast("double")))


def whole_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) of the usable rows, and the number of dimensions."""
    used = table.select(F.col(id_column), F.col(vector).alias("x")).where(_usable(F.col("x")))
    width = used.agg(F.max(F.size("x"))).first()[0] or 0
    whole = F.transform("x", lambda v: F.floor(v.cast("double") * SCALE))
    filled = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    return used.select(id_column, filled.alias("x")), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums of 64-bit whole numbers as Python numbers."""
    low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
    return high.astype(object) * (1 << 32) + low.astype(object)


def _partial_moments(rows_of, width: int):
    """Worker function: one row per dimension with the count, the sum, the mean and
    the scatter about the mean of the rows that ``rows_of`` makes of a task's vectors."""
    def run(batches):
        n, mean, scatter = 0, np.zeros(width), np.zeros((width, width))
        total = np.zeros(width, object)
        for batch in batches:
            rows = rows_of(batch.column(0))
            if not len(rows):
                continue
            if rows.dtype.kind == "i":
                total += _exact_sums(rows)
            rows = rows.astype(np.float64)
            own = rows.mean(0)
            centred, step, more = rows - own, own - mean, len(rows)
            scatter += centred.T @ centred + np.outer(step, step) * (n * more / (n + more))
            mean = mean + step * (more / (n + more))
            n += more
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n, np.int64)),
                 pa.array([int(t) for t in total], pa.decimal128(38, 0)), pa.array(mean),
                 pa.array([mean] * width, pa.list_(pa.float64())), pa.array(list(scatter), pa.list_(pa.float64()))],
                names=["dim", "n", "total", "own", "means", "scatter"])

    return run


def _moments(vectors: DataFrame, rows_of, width: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """(n, exact sums, means, scatter about the means) over all rows of ``vectors``."""
    parts = C.stored(vectors.mapInArrow(_partial_moments(rows_of, width), _PARTS), "moments")
    sums = {r.dim: r for r in parts.groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("own") * F.col("n")).alias("mass")).collect()}
    if not sums:
        return 0, [], np.zeros(0), np.zeros((0, 0))
    n = sums[0].n
    totals = [int(sums[i].total) for i in range(width)]
    exact = any(totals)
    means = np.array([totals[i] / n if exact else sums[i].mass / n for i in range(width)])
    mean = F.array(*[F.lit(float(m)) for m in means])
    cells = parts.select("dim", "n", (F.col("own") - F.element_at(mean, F.col("dim") + 1)).alias("off"),
                         F.posexplode(F.arrays_zip("means", "scatter")).alias("other", "cell"))
    between = F.col("n") * F.col("off") * (F.col("cell.means") - F.element_at(mean, F.col("other") + 1))
    scatter = np.zeros((width, width))
    for r in cells.groupBy("dim", "other").agg(F.sum(F.col("cell.scatter") + between).alias("v")).collect():
        scatter[r.dim, r.other] = r.v
    return n, totals, means, (scatter + scatter.T) / 2


# --------------------------------------------------------------------------
# Factor and rotations (one width x width table)
# --------------------------------------------------------------------------

def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L) with a[order][:, order] = L L' and L lower trapezoidal; the
    next pivot is the largest diagonal left, down to the numerical rank."""
    a, d = a.copy(), len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(a.diagonal().max(), 0.0) if d else 0.0
    for k in range(d):
        at = k + int(np.argmax(a.diagonal()[k:]))
        if a[at, at] <= floor:
            return order, factor[:, :k]
        swap = [at, k]
        order[[k, at]] = order[swap]
        a[[k, at]] = a[swap]
        a[:, [k, at]] = a[:, swap]
        factor[[k, at]] = factor[swap]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return order, factor


def one_sided_jacobi(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """The columns rotated in pairs until all are orthogonal. A round takes disjoint pairs,
    every pair once in a sweep (as in a round-robin tournament)."""
    columns = factor.T.copy()
    if len(columns) % 2:
        columns = np.vstack([columns, np.zeros(columns.shape[1])])
    m = len(columns)
    ring = list(range(m))
    tolerance = np.finfo(float).eps * max(m, 1)
    for _ in range(most_sweeps):
        turned = False
        for _ in range(max(m - 1, 0)):
            p, q = np.array(ring[:m // 2]), np.array(ring[:m // 2 - 1:-1])
            x, y = columns[p], columns[q]
            a, b, g = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            go = np.abs(g) > tolerance * np.sqrt(a * b)
            if go.any():
                turned = True
                p, q, x, y, a, b, g = p[go], q[go], x[go], y[go], a[go], b[go], g[go]
                zeta = (b - a) / (2 * g)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                columns[p], columns[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if not turned:
            break
    return columns[:factor.shape[1]].T


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues, falling, and unit eigenvectors as columns."""
    order, factor = pivoted_cholesky(scatter)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    rank = np.argsort(-norms, kind="stable")
    rank = rank[norms[rank] > 0]
    vectors = np.zeros((len(scatter), len(rank)))
    vectors[order] = rotated[:, rank] / norms[rank]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(len(rank))] if len(rank) else np.zeros(0)
    return norms[rank] ** 2, vectors * np.where(largest < 0, -1.0, 1.0)


# --------------------------------------------------------------------------
# Model
# --------------------------------------------------------------------------

@dataclass
class Whitening:
    """A fitted model: ``n`` distinct vectors with exact ``sums``, all positive
    eigenvalues of the covariance, the unit ``components`` (columns) that are kept."""
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return (self.eigenvalues / self.eigenvalues.sum())[:self.components.shape[1]].tolist()

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        most = max(int(np.abs(x, dtype=np.float64).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if most < 1 << 61:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        off = self.offsets(x)
        most = float(np.abs(off.astype(np.float64)).max(initial=0))
        if off.dtype != object and most * most * self.width < 2.0 ** 62:
            return (off * off).sum(1).tolist()
        exact = (off.astype(object) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        k = self.components.shape[1]
        return (self.offsets(x).astype(np.float64) / self.n) @ self.components / np.sqrt(self.eigenvalues[:k])


def fit_whitening(distinct: DataFrame, width: int, components: int) -> Whitening:
    """The model of a table of distinct vectors ``x``."""
    n, sums, _, scatter = _moments(distinct, lambda c: _matrix(c, width), width) if width else (0, [], None, np.zeros((0, 0)))
    values, vectors = eigen(scatter)
    return Whitening(n, sums, values / max(n, 1), vectors[:, :components])


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus
    the identity, from the vectors themselves."""
    k, width = model.components.shape[1], model.width
    n, _, _, scatter = _moments(distinct, lambda c: model.whitened(_matrix(c, width)), k)
    return float(np.abs(scatter / n - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vectors`` (id, x) with its exact ``deviation`` and ``whitened``, one
    number per component."""
    name, kind = vectors.schema[0].name, vectors.schema[0].dataType.simpleString()
    width = model.width

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.deviations(x), pa.int64()),
                 pa.array(list(model.whitened(x)), pa.list_(pa.float64()))], names=[name, "deviation", "whitened"])

    return vectors.mapInArrow(run, f"`{name}` {kind}, deviation long, whitened array<double>")


def whitening_report(table: DataFrame, components: int = 4, id_column: str = "vec_id",
                     vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: its whitened coordinate, with the
    exact deviation, the component's share of the variance and the identity error."""
    C.small_batches(table.sparkSession)
    vectors, width = whole_vectors(table, id_column, vector)
    distinct = C.stored(vectors.select("x").distinct(), "distinct_vectors")
    model = fit_whitening(distinct, width, components)
    shares = model.explained
    if not shares:
        none = ("component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double")
        return vectors.select(id_column, *[F.lit(None).cast(t).alias(c) for c, t in map(str.split, none)]).where(F.lit(False))
    error = identity_error(distinct, model)
    rows = whiten(vectors, model).select(id_column, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1)
    return rows.select(id_column, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
