"""Operator 11: whitening of fixed-point embeddings by shifted CholeskyQR.

Entries c become whole numbers x = floor(scale * c) + offset.  Their sums S are
exact, so the centred rows (n x - S) / n are rounded once, however far the
offset lies from the mean.  Of the centred n x d matrix A no row leaves its
task but in the result; each pass scans the vectors once and adds up d x d sums:

1. Gram pass of A; Cholesky factor R1 of the Gram matrix plus a shift that
   makes it positive definite whatever the condition.
2. Gram pass of Q = A R1^-1, every row by a triangular solve; R2 of that Gram
   matrix, and so on through all factors so far until Q's columns are
   orthonormal to rounding.  A Gram matrix that is not positive definite (columns
   that depend on each other) is shifted again.
3. R = ... R2 R1 has the singular values and right singular vectors of A, so
   the SVD of the d x d matrix R gives components and eigenvalues e = s^2 / n.
   Where A has dependent columns, Q never gets orthonormal; the square root of
   its last Gram matrix then takes the place of the last factor.
4. Two more passes (mean, then covariance about it) measure how far the
   covariance of the whitened rows is from the identity.

The driver holds d x d matrices only.

Defined results: vectors that are null or hold a null, NaN or infinity are
dropped; so are empty ones and those of another length than the commonest one (ties: the
longer); nulls in the id stay; repeated rows count and return as often as they come.  With
less than ``components`` dimensions there are fewer components.  A direction without
variance (dependent columns, a single vector) has whitened and explained 0 and
is left out of identity_error.  No usable vector gives no rows.  A number
beyond a long raises an error: nothing wraps around.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = T.DecimalType(38, 0)
#: Below this share of the trace a direction counts as one without variance.
NO_VARIANCE = 1e-24
MOST_PASSES = 8


@dataclass
class FixedPoint:
    scale: int = 1024
    offset: int = 100_000

    def of(self, entries: np.ndarray) -> np.ndarray:
        scaled = np.floor(entries.astype(np.float64) * self.scale)
        if scaled.size and np.abs(scaled).max() >= 2.0 ** 62:
            raise ValueError("an entry does not fit a long as a fixed-point number")
        return scaled.astype(np.int64) + self.offset


@dataclass
class Whitening:
    """What the fit learned; ``vectors`` columns are the components."""
    fixed: FixedPoint
    n: int
    sums: list[int]
    wide: bool  # n x - S may leave 62 bits
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float = 0.0

    def scaled_deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64, or Python ints where those could overflow."""
        if self.wide:
            return x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return x * self.n - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled_deviations(x) / self.n).astype(np.float64)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        live = self.eigenvalues > NO_VARIANCE * self.trace
        return (centred @ self.vectors) * np.where(live, 1 / np.sqrt(np.where(live, self.eigenvalues, 1)), 0.0)


def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """``rows`` with finite vectors of the commonest length, and that length."""
    col = F.col(f"`{vector}`")
    number = F.forall(col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    finite = rows.filter((F.size(col) > 0) & F.coalesce(number, F.lit(False)))
    common = (finite.groupBy(F.size(col).alias("d")).count()
              .orderBy(F.desc("count"), F.desc("d")).limit(1).collect())
    d = common[0]["d"] if common else 0
    return finite.filter(F.size(col) == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(rows: DataFrame, vector: str, shape: tuple[int, int],
            batch_total: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum over all rows of a ``shape`` matrix: added up in each task, then by place."""
    def run(batches: Iterator[pa.RecordBatch]):
        total, any_rows = np.zeros(shape), False
        for b in batches:
            if b.num_rows:
                total, any_rows = total + batch_total(_matrix(b.column(0), d)), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    got = (rows.select(F.col(f"`{vector}`").alias("v")).mapInArrow(run, "at long, v double")
           .groupBy("at").agg(F.sum("v").alias("v")).toArrow())
    out = np.zeros(shape[0] * shape[1])
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(shape)


def exact_sums(rows: DataFrame, vector: str, fixed: FixedPoint, d: int) -> Whitening:
    """Row count, exact sums and the range of the fixed-point entries."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                x = fixed.of(_matrix(b.column(0), d))
                most = int(np.abs(x).max())
                sums = x.sum(axis=0) if most < 2 ** 62 // len(x) else x.astype(object).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(d)), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)),
                     pa.array([len(x)] * d, pa.int64()), pa.array([most] * d, pa.int64())], ["at", "s", "n", "most"])

    got = (rows.select(F.col(f"`{vector}`").alias("v")).mapInArrow(run, "at long, s decimal(38,0), n long, most long")
           .groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("most").alias("most"))
           .orderBy("at").collect())
    n, most = (got[0]["n"], max(r["most"] for r in got)) if got else (0, 0)
    return Whitening(fixed, n, [int(r["s"]) for r in got], wide=2 * n * most >= 2 ** 62)


def triangular_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = rows, R upper triangular: forward substitution, column by column."""
    q = np.empty_like(rows)
    for j in range(rows.shape[1]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def orthogonalised(centred: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for r in factors:
        centred = triangular_solve(centred, r)
    return centred


def shifted_factor(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper Cholesky factor of ``gram`` plus the shift that outweighs its rounding errors."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def triangular_factor(gram_of: Callable[[list[np.ndarray]], np.ndarray], n: int, d: int) -> tuple[np.ndarray, float]:
    """Matrix M with MᵀM = AᵀA (triangular unless columns depend on each other), and the trace of AᵀA."""
    first = gram_of([])
    trace = float(np.trace(first))
    if trace == 0:
        return np.zeros((d, d)), 0.0
    factors, last = [shifted_factor(first, n)], None
    for _ in range(MOST_PASSES):
        last = gram_of(factors)
        if np.abs(last @ last - last).max() <= 1e-12 * d:  # orthonormal, or so on a subspace
            break
        try:
            factors.append(np.linalg.cholesky(last).T)
        except np.linalg.LinAlgError:
            if np.abs(last @ last - last).max() <= 1e-8:  # a projector: dependent columns
                break
            factors.append(shifted_factor(last, n))
        last = None
    r = np.eye(d)
    for f in factors:
        r = f @ r
    if last is not None:
        values, vectors = np.linalg.eigh(last)
        r = (np.sqrt(np.maximum(values, 0))[:, None] * vectors.T) @ r
    return r, trace


def fit(rows: DataFrame, d: int, vector: str = "embedding", components: int = 8,
        fixed: FixedPoint | None = None) -> Whitening:
    """Whitening of ``rows``, which ``usable`` has made finite and of length ``d``."""
    fixed = fixed or FixedPoint()
    model = exact_sums(rows, vector, fixed, d) if d else Whitening(fixed, 0, [], False)
    if not model.n:
        return model

    def gram_of(factors: list[np.ndarray]) -> np.ndarray:
        def one(v):
            q = orthogonalised(model.centred(fixed.of(v)), factors)
            return q.T @ q
        return _totals(rows, vector, (d, d), one, d)

    r, trace = triangular_factor(gram_of, model.n, d)
    _, s, vt = np.linalg.svd(r)
    k = min(components, d)
    vectors = vt[:k].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    model.eigenvalues, model.vectors, model.trace = s[:k] ** 2 / model.n, vectors, trace / model.n
    model.identity_error = _identity_error(rows, vector, model, d)
    return model


def _identity_error(rows: DataFrame, vector: str, model: Whitening, d: int) -> float:
    k = len(model.eigenvalues)

    def whitened(v):
        return model.whiten(model.centred(model.fixed.of(v)))

    mean = _totals(rows, vector, (1, k), lambda v: whitened(v).sum(axis=0, keepdims=True), d) / model.n

    def spread(v):
        z = whitened(v) - mean
        return z.T @ z

    cov = _totals(rows, vector, (k, k), spread, d) / model.n
    live = model.eigenvalues > NO_VARIANCE * model.trace
    return float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max(initial=0.0))


def transform(rows: DataFrame, model: Whitening, d: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, whitened array<double>, deviation decimal(38,0)) of each row."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            x = model.fixed.of(_matrix(b.column(1), d))
            apart = model.scaled_deviations(x)
            most = max(abs(int(apart.max())), abs(int(apart.min())))
            if most * most * d < 2 ** 63:
                deviation = pa.array((apart.astype(np.int64) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = apart.astype(object)
                deviation = pa.array([Decimal(int(s)) for s in (exact * exact).sum(axis=1)], pa.decimal128(38, 0))
            z = model.whiten(model.centred(x))
            lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, deviation], [key, "whitened", "deviation"])

    out = T.StructType([T.StructField(key, kind), T.StructField("whitened", T.ArrayType(T.DoubleType())),
                        T.StructField("deviation", EXACT)])
    return rows.select(F.col(f"`{key}`"), F.col(f"`{vector}`")).mapInArrow(run, out)


def whitened_components(rows: DataFrame, components: int = 8, vector: str = "embedding", key: str = "vec_id",
                        fixed: FixedPoint | None = None) -> DataFrame:
    """One row per usable vector and component, with the figures of the fit."""
    good, d = usable(rows, vector)
    model = fit(good, d, vector, components, fixed)
    shares = model.eigenvalues / model.trace if model.trace else np.zeros(len(model.eigenvalues))
    shares = [float(s) if s > NO_VARIANCE else 0.0 for s in shares]
    each = transform(good, model, max(d, 1), vector, key).select(
        F.col(f"`{key}`"), "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        F.col(f"`{key}`"), (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(F.lit(shares or [0.0]), F.col("_at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))
