"""Quality classification from trusted positives and unlabelled text.

A small network on shape features of whole texts minimises the non-negative
positive-unlabelled risk: prior * R+(positives) + max(0, R-(unlabelled) -
prior * R-(positives)), with the logistic loss. The class prior is the share of
positives among labelled rows. The output is then put on the scale of
probabilities by a logistic fit on the labelled learning rows, so that a fixed
threshold means the same at every size.

Fitting reads bounded samples (`max_positive`, `max_unlabelled`, `max_negative`
rows, chosen by a hash of ids); scoring reads every whole text.

Defined results: null and empty texts get the score of a text without words;
equal texts get equal scores; labels that are null, or of ids without a document,
are ignored, and of several labels of an id the lowest counts; without labels
every score is 0.5; rows whose ids are no whole numbers are scored, and not learned
from; other columns are kept by `keep` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as T

MAX_POSITIVE, MAX_UNLABELLED, MAX_NEGATIVE = 6000, 8000, 3000
HIDDEN, STEPS = 16, 300
THRESHOLD = 0.7
_SYMBOLS = "|%&$#*!?.,:;-_/<>=@()[]{}"
N_FEATURES = 22 + len(_SYMBOLS)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent one's count, by row."""
    if not len(hashes):
        return np.zeros(rows), np.zeros(rows)
    key = T.mix64(hashes + T.mix64(row.astype(np.uint64)))
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    size = np.diff(np.append(first, len(key)))
    owner = row[order[first]]
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, owner, size)
    return np.bincount(owner, minlength=rows), most


def features(column: pa.Array) -> np.ndarray:
    """A row of N_FEATURES for every text."""
    out = np.zeros((len(column), N_FEATURES))
    for chunk in T.chunks(column):
        rows, cps, bounds = chunk.rows, chunk.cps, chunk.bounds
        made = out[chunk.first : chunk.first + rows]
        n = np.diff(bounds).astype(float)

        def per_row(flags: np.ndarray, bounds: np.ndarray = bounds) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds]).astype(float)

        kind = T.class_table()[cps]
        letter, other = kind == T.LETTER, kind == T.OTHER
        letters = per_row(letter)
        upper = per_row(letter & (T.lower_table()[cps] != cps))
        same = np.zeros(len(cps), bool)
        same[1:] = (cps[1:] == cps[:-1]) & other[1:]
        found = T.words(chunk)
        count = np.diff(found.bounds)
        w = count.astype(float)
        row = np.repeat(np.arange(rows), count)
        size = found.lengths.astype(float)
        total, squares = np.bincount(row, size, rows), np.bincount(row, size**2, rows)
        distinct, most = _distinct(found.hashes, row, rows)
        pair = np.zeros(0, np.uint64) if len(row) < 2 else T.mix64(found.hashes[1:] ^ (found.hashes[:-1] << np.uint64(1)))
        inside = row[1:] == row[:-1]
        pairs, _ = _distinct(pair[inside], row[1:][inside], rows)
        adjacent = np.bincount(row[1:][inside & (found.hashes[1:] == found.hashes[:-1])], minlength=rows) if len(row) > 1 else np.zeros(rows)
        newline = cps == 10
        cut = newline.copy()
        starts = np.unique(np.concatenate([np.flatnonzero(cut) + 1, bounds[:-1][n > 0]])) if len(cps) else np.zeros(0, np.int64)
        starts = starts[starts < len(cps)]
        lengths = np.diff(np.append(starts, len(cps)))
        line_row = np.searchsorted(bounds, starts, "right") - 1
        lines = np.bincount(line_row, minlength=rows).astype(float)
        unique_lines, most_lines = _distinct(T.run_hashes(cps, starts, lengths), line_row, rows)
        made[:, 0] = np.log1p(n)
        made[:, 1] = np.log1p(w)
        made[:, 2] = _ratio(letters, n)
        made[:, 3] = _ratio(per_row(kind == T.NUMBER), n)
        made[:, 4] = _ratio(per_row(kind == T.SPACE), n)
        made[:, 5] = _ratio(per_row(other), n)
        made[:, 6] = _ratio(upper, letters)
        made[:, 7] = _ratio(per_row(same), n)
        made[:, 8] = _ratio(total, w)
        made[:, 9] = np.sqrt(np.maximum(0, _ratio(squares, w) - made[:, 8] ** 2))
        made[:, 10] = _ratio(np.bincount(row, size <= 3, rows), w)
        made[:, 11] = _ratio(np.bincount(row, size > 15, rows), w)
        made[:, 12] = _ratio(distinct, w)
        made[:, 13] = _ratio(distinct, np.sqrt(w))
        made[:, 14] = _ratio(most, w)
        made[:, 15] = _ratio(pairs, np.maximum(w - 1, 1))
        made[:, 16] = _ratio(adjacent, w)
        made[:, 17] = np.log1p(lines)
        made[:, 18] = _ratio(unique_lines, lines)
        made[:, 19] = _ratio(most_lines, lines)
        made[:, 20] = _ratio(w, lines)
        made[:, 21] = n == 0
        for k, c in enumerate(_SYMBOLS):
            made[:, 22 + k] = _ratio(per_row(cps == ord(c)), w)
    made = out
    np.log1p(made[:, 20], out=made[:, 20])
    return made


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    a: float
    c: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * self.raw(x) + self.c)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Model:
    """Minimises the non-negative unbiased risk by Adam on all rows of the sample."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    rng = np.random.default_rng(seed)
    x, p = np.clip((both - mean) / scale, -8, 8), len(positive)
    par = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in par], [np.zeros_like(q) for q in par]
    for step in range(1, steps + 1):
        h = np.tanh(x @ par[0] + par[1])
        g = h @ par[2] + par[3][0]
        s = _sigmoid(g)
        # d/dg of log(1 + exp(-g)) is s - 1, of log(1 + exp(g)) is s
        unlabelled_risk = np.logaddexp(0, g[p:]).mean() - prior * np.logaddexp(0, g[:p]).mean()
        d = np.zeros_like(g)
        d[:p] += prior * (s[:p] - 1) / p
        sign = 1.0 if unlabelled_risk >= 0 else -1.0  # below zero: climb back instead of fitting noise
        if sign < 0:
            d[:p] = 0
        d[p:] += sign * s[p:] / max(1, len(g) - p)
        d[:p] -= sign * prior * s[:p] / p
        dh = np.outer(d, par[2]) * (1 - h**2)
        grads = [x.T @ dh + 1e-4 * par[0], dh.sum(axis=0), h.T @ d + 1e-4 * par[2], np.array([d.sum()])]
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            par[k] = par[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, par[0], par[1], par[2], float(par[3][0]), 1.0, 0.0, prior)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Logistic scale of the raw output on labelled rows (Newton steps, smoothed targets)."""
    if len(np.unique(y)) < 2:
        return model
    z = model.raw(x)
    shift, spread = z.mean(), max(z.std(), 1e-6)
    t = np.stack([(z - shift) / spread, np.ones_like(z)], axis=1)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.zeros(2)
    for _ in range(50):
        s = _sigmoid(t @ beta)
        hess = (t * (weight * s * (1 - s))[:, None]).T @ t + 1e-3 * np.eye(2)
        beta += np.linalg.solve(hess, t.T @ (weight * (target - s)) - 1e-3 * beta)
    a = beta[0] / spread
    return model._replace(a=float(a), c=float(beta[1] - a * shift))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """At most `n` ids, by a hash of them: the bound of a fitting sample."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, *, label_col: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_negative: int = MAX_NEGATIVE) -> Model | None:
    """A model from the labels of ids for which `learnable` (of doc_id) is true; None without positives or documents."""
    ids = labels.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col(label_col).try_cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = ids.groupBy("doc_id").agg(F.min("y").alias("y"))
    usable = known.filter(learnable)
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return None
    prior = float(np.clip(counts[1] / sum(counts.values()), 0.05, 0.95))
    free = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id")).filter(F.col("doc_id").isNotNull() & learnable).join(known, "doc_id", "left_anti").distinct()
    chosen = _first(usable.filter("y = 1"), max_positive).unionByName(_first(usable.filter("y = 0"), max_negative)).unionByName(_first(free, max_unlabelled).withColumn("y", F.lit(-1)))
    sample = scratch.materialise(chosen, "quality-sample")  # at most the sum of the three bounds
    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    found = rows.mapInArrow(scratch.lean(run), "y int, x array<double>").toArrow()
    y = found.column(0).to_numpy()
    if not (y == 1).any():
        return None
    x = np.array(found.column(1).to_pylist(), float).reshape(len(y), N_FEATURES)
    order = np.lexsort((*x.T, y))  # the order of arrival doesn't matter
    x, y = x[order], y[order]
    unlabelled = x[y == -1] if (y == -1).any() else x
    model = fit_pu(x[y == 1], unlabelled, prior)
    share = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts.get(0, 0) / max(1, (y == 0).sum()))
    known_rows = y >= 0
    return calibrate(model, x[known_rows], y[known_rows], share[known_rows] * known_rows.sum() / sum(counts.values()))


def score(docs: DataFrame, model: Model | None, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` with score and predicted."""
    keep = ["doc_id"] if keep is None else keep
    plain = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept_fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.full(batch.num_rows, 0.5) if model is None else model.score(features(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(made), pa.array((made >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return plain.mapInArrow(scratch.lean(run), f"{kept_fields}score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns unchanged, whose texts reach the threshold; without a model all stay."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= threshold))

    return docs.mapInArrow(scratch.lean(run), docs.schema)
