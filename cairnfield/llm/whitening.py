"""Whitening of embeddings: Welford's streaming covariance, merged by the parallel update, and a symmetric QR eigen-solve.

Entries are put on an integer grid, x = floor(scale * c) + offset, so sums are
exact. Each task streams its vectors through rank-one updates of count, mean and
scatter; the tasks' states are merged pairwise by the parallel formula in a tree
of Spark shuffles, so the driver gets one state, whose size depends on the
dimension alone. There the covariance is reduced to a tridiagonal matrix by
reflections and diagonalised by implicit QR steps with Wilkinson's shift. Rows
are projected in a last pass without a shuffle.

Defined results: vectors that are null, empty, or hold null or non-finite
entries, or entries of 2**53 / scale and more in size (which have no exact
integer), are dropped; vectors of different lengths are lists of their own, each
with its own covariance; repeated rows count as often as they occur; ids are
handed on as they are, null ones too; directions without variance (eigenvalue
within rounding of zero) have no component, so equal vectors alone give no rows;
a deviation beyond the range of a long is null; an empty table gives an empty
table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
FAN_IN = 16
STATE_SCHEMA = "at bigint, dim int, n bigint, sums string, mean binary, scatter binary"
_STATE = pa.schema([("at", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.string()), ("mean", pa.binary()), ("scatter", pa.binary())])
_LONG = 1 << 63


class Moments:
    """Count, exact sums, mean and scatter (sum of centred outer products) of vectors of one length."""

    def __init__(self, dim: int) -> None:
        self.n, self.sums = 0, [0] * dim
        self.mean, self.scatter = np.zeros(dim), np.zeros((dim, dim))

    def add(self, rows: np.ndarray, *, exact: bool = True) -> None:
        """Welford's update by each row: the scatter grows by the outer product of the deviations before and after the mean's step."""
        n, mean, scatter = self.n, self.mean, self.scatter
        outer = np.empty_like(scatter)
        for row in rows:
            n += 1
            before = row - mean
            mean += before / n
            np.multiply.outer(before, row - mean, out=outer)
            scatter += outer
        self.n = n
        if exact:
            self.sums = [a + b for a, b in zip(self.sums, exact_sums(rows), strict=True)]

    def merge(self, other: Moments) -> None:
        """The parallel update: both scatters, and the means' difference by n * m / (n + m)."""
        total = self.n + other.n
        if not total:
            return
        gap = other.mean - self.mean
        self.scatter += other.scatter + np.multiply.outer(gap, gap) * (self.n / total * other.n)
        self.mean = self.mean + gap * (other.n / total)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = total

    def covariance(self) -> np.ndarray:
        found = self.scatter / self.n
        return (found + found.T) / 2

    def row(self, at: int) -> dict:
        return {"at": at, "dim": len(self.sums), "n": self.n, "sums": ",".join(map(str, self.sums)), "mean": self.mean.tobytes(), "scatter": self.scatter.tobytes()}

    @classmethod
    def of(cls, row: dict) -> Moments:
        own = cls(0)
        own.n, own.sums = row["n"], [int(x) for x in row["sums"].split(",")]
        own.mean = np.frombuffer(row["mean"]).copy()
        own.scatter = np.frombuffer(row["scatter"]).reshape(row["dim"], row["dim"]).copy()
        return own


def exact_sums(rows: np.ndarray) -> list[int]:
    """Column sums of integer-valued doubles, exact at any size."""
    whole = rows.astype(np.int64)
    if not len(rows) or float(np.abs(rows).max()) * len(rows) < 2.0**62:
        return whole.sum(axis=0).tolist()
    return whole.astype(object).sum(axis=0).tolist()


# ------------------------------------------------------------------------------------------------------- eigen-solve


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and orthogonal q with q.T @ a @ q tridiagonal, by Householder reflections."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = math.hypot(*x)
        if not np.any(x[1:]):
            continue
        v = x / size
        v[0] += math.copysign(1.0, v[0])
        v /= math.sqrt(v @ v)
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = 2 * (p - (v @ p) * v)
        part -= np.multiply.outer(v, w) + np.multiply.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = -math.copysign(size, x[0])
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[:, k + 1 :] -= np.multiply.outer(q[:, k + 1 :] @ (2 * v), v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, by implicit QR steps on the tridiagonal form."""
    n = len(a)
    d, e, q = tridiagonal(a)
    rows = np.ascontiguousarray(q.T)  # rotations act on rows
    small, end, steps = np.finfo(float).eps, n - 1, 0
    while end > 0:
        for k in range(end):
            if abs(e[k]) <= small * (abs(d[k]) + abs(d[k + 1])) or abs(e[k]) < 1e-300:
                e[k] = 0.0
        if e[end - 1] == 0.0:
            end, steps = end - 1, 0
            continue
        first = end - 1
        while first > 0 and e[first - 1] != 0.0:
            first -= 1
        steps += 1
        if steps > 100:
            raise ArithmeticError("the QR steps don't converge")
        half = (d[end - 1] - d[end]) / 2
        last = e[end - 1]
        shift = d[end] - last * (last / (half + math.copysign(math.hypot(half, last), half)))
        x, z = d[first] - shift, e[first]
        for k in range(first, end):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            dk, ek, dn = d[k], e[k], d[k + 1]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            x = e[k]
            if k < end - 1:
                z = s * e[k + 1]
                e[k + 1] *= c
            upper = rows[k].copy()
            rows[k] = c * upper + s * rows[k + 1]
            rows[k + 1] = c * rows[k + 1] - s * upper
    order = np.argsort(-d, kind="stable")
    return d[order], rows[order].T


# ------------------------------------------------------------------------------------------------------------ passes


def grid(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """`id` and `v` (array of doubles, whole numbers): floor(scale * c) of the rows that have only finite entries."""
    entry = F.col(vector_col).cast("array<double>")
    kept = embeddings.select(F.col(id_col).alias("id"), entry.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(1 << 53))))
    return kept.select("id", F.col("c").alias("v"))


def _vectors(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: places in the batch and the matrix of its vectors on the grid."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    flat = np.floor(scale * column.values.to_numpy())
    size = np.diff(bounds)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield at, flat[bounds[at][:, None] + np.arange(dim)]


def _merged(states: DataFrame, parts: int) -> dict[int, Moments]:
    """One state a length: FAN_IN states become one in each round of shuffles."""

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        own = Moments.of(rows[0])
        for r in rows[1:]:
            own.merge(Moments.of(r))
        return pa.Table.from_pylist([own.row(rows[0]["at"] // FAN_IN)], schema=_STATE)

    while parts > 1:
        states = states.groupBy((F.col("at") / FAN_IN).cast("bigint").alias("group"), F.col("dim").alias("length")).applyInArrow(one, STATE_SCHEMA)
        parts = -(-parts // FAN_IN)
    return {r["dim"]: Moments.of(r.asDict()) for r in states.collect()}


def moments(rows: DataFrame, *, scale: int = SCALE) -> dict[int, Moments]:
    """Moments of all vectors of `grid`'s rows, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for batch in batches:
            for at, x in _vectors(batch.column(0), scale):
                own.setdefault(x.shape[1], Moments(x.shape[1])).add(x)
        yield from pa.Table.from_pylist([m.row(TaskContext.get().partitionId()) for _, m in sorted(own.items())], schema=_STATE).to_batches()

    states = rows.select("v").mapInArrow(scratch.lean(run), STATE_SCHEMA)
    return _merged(states, rows.rdd.getNumPartitions())


class Whitening(NamedTuple):
    """What projects vectors of one length: column k of `project` is eigenvector k over the root of its eigenvalue."""

    n: int
    sums: list[int]
    project: np.ndarray
    explained: np.ndarray
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows. Centring is x - S / n, with the whole part of S / n taken off exactly first."""
        whole = np.array([s // self.n for s in self.sums], float)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole - rest) @ self.project

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; the offset cancels out."""
        most = float(np.abs(x).max(initial=0.0)) * self.n + max(map(abs, self.sums), default=0)
        whole = x.astype(np.int64)
        if x.shape[1] * most * most < 2.0**62:
            gap = whole * self.n - np.array(self.sums, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        gap = whole.astype(object) * self.n - np.array(self.sums, object)
        return [d if d < _LONG else None for d in (gap * gap).sum(axis=1).tolist()]


def solve(m: Moments, components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of the covariance by falling eigenvalue; those within rounding of zero are left out."""
    values, vectors = symmetric_qr(m.covariance())
    trace = float(np.trace(m.covariance()))
    kept = int((values[:components] > 16 * len(values) * np.finfo(float).eps * max(trace, 0.0)).sum()) if trace > 0 else 0
    values, vectors = values[:kept], vectors[:, :kept]
    return Whitening(m.n, m.sums, vectors / np.sqrt(values), values / trace if kept else values, 0.0)


def fit(rows: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE) -> dict[int, Whitening]:
    """Whitenings by length, fitted on all of `grid`'s rows; the identity error is measured by a second pass over the whitened rows."""
    models = {dim: solve(m, components) for dim, m in moments(rows, scale=scale).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for batch in batches:
            for _, x in _vectors(batch.column(0), scale):
                model = models[x.shape[1]]
                if model.project.shape[1]:
                    own.setdefault(x.shape[1], Moments(model.project.shape[1])).add(model.apply(x), exact=False)
        found = [m.row(TaskContext.get().partitionId()) | {"n": m.n, "sums": ",".join(["0"] * len(m.sums))} for _, m in sorted(own.items())]
        # states of different lengths may have equally many components: told apart by the length
        for row, dim in zip(found, sorted(own), strict=True):
            row["at"] += dim << 40
        yield from pa.Table.from_pylist(found, schema=_STATE).to_batches()

    errors = {}
    if any(m.project.shape[1] for m in models.values()):
        for dim, m in models.items():
            if not m.project.shape[1]:
                continue
            own = rows.select("v").filter(F.size("v") == dim) if len(models) > 1 else rows.select("v")
            states = own.mapInArrow(scratch.lean(run), STATE_SCHEMA).withColumn("at", F.col("at").bitwiseAND((1 << 40) - 1)).select(*_STATE.names)
            (state,) = _merged(states, rows.rdd.getNumPartitions()).values()
            errors[dim] = float(np.abs(state.covariance() - np.eye(len(state.mean))).max())
    return {dim: m._replace(identity_error=errors.get(dim, 0.0)) for dim, m in models.items()}


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = grid(embeddings, id_col=id_col, vector_col=vector_col, scale=scale)
    scratch.small_batches(rows.sparkSession)
    models = fit(rows, components=components, scale=scale)
    schema = rows.select("id").schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    kinds = [("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _vectors(batch.column(1), scale):
                model = models[x.shape[1]]
                k = model.project.shape[1]
                if not k:
                    continue
                y, ids = model.apply(x), batch.column(0).take(pa.array(np.repeat(at, k)))
                many = len(at) * k
                deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                columns = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(many, model.n)), deviation, pa.array(y.ravel()), pa.array(np.tile(model.explained, len(at))), pa.array(np.full(many, model.identity_error))]
                yield pa.RecordBatch.from_arrays([ids, *columns], schema=pa.schema([("id", ids.type), *kinds]))

    return rows.mapInArrow(scratch.lean(run), schema).withColumnRenamed("id", id_col)
