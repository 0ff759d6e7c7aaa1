"""A seeded 32-bit generator in counter form: draw i depends on seed and i alone, so draws are column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
STEP = 0x6D2B79F5  # fixed value of the generator


def imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of unsigned 32-bit integers held in 64 bits."""
    low = a.bitwiseAND(F.lit(65535)) * b
    high = F.shiftleft((F.shiftright(a, 16) * b.bitwiseAND(F.lit(65535))).bitwiseAND(F.lit(65535)), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def draw(seed: int, i: Column) -> Column:
    """The i-th draw (from 1) in [0, 1)."""
    mask = F.lit(MASK).cast("bigint")
    a = (F.lit(seed % 2**32).cast("bigint") + i.cast("bigint") % F.lit(2**32) * F.lit(STEP)).bitwiseAND(mask)
    t = imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("bigint")))
    u = imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("bigint")))
    t = t.bitwiseXOR((t + u).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftright(t, 14)).bitwiseAND(mask) / F.lit(4294967296.0)


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """The draws numbered first, first + 1, ... (from 1): any part of the sequence without what comes before it."""
    mask = np.uint64(MASK)
    a = (np.uint64(seed % 2**32) + np.arange(first, first + count, dtype=np.uint64) * np.uint64(STEP)) & mask
    t = ((a ^ a >> np.uint64(15)) * (a | np.uint64(1))) & mask
    t ^= (t + (((t ^ t >> np.uint64(7)) * (t | np.uint64(61))) & mask)) & mask
    return ((t ^ t >> np.uint64(14)) & mask) / 4294967296.0


CHUNK, FEW = 1 << 16, 2000


def _swaps(n: int, seed: int, before: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and j that a shuffle of n items from the end has swapped, its last swap (i = 1) first; `before` draws were used up earlier."""
    for a in range(1, n, CHUNK):
        b = min(n, a + CHUNK)
        i = np.arange(a, b)
        yield i, (draws(seed, before + n - b + 1, b - a)[::-1] * (i + 1)).astype(np.int64)


def first_places(n: int, want: int, seed: int, before: int = 0) -> np.ndarray:
    """Which of n items stand at the first `want` places after a seeded Fisher-Yates shuffle from the end.

    The swaps are undone from the last to the first for these places alone, so memory is that of a chunk of draws, whatever n is.
    """
    if want > FEW:
        return permutation(n, seed, before)[:want]
    place = np.arange(min(want, n))
    for i, j in _swaps(n, seed, before):
        at = 0
        while at < len(i):
            hit = np.flatnonzero(np.isin(j[at:], place) | np.isin(i[at:], place))
            if not len(hit):
                break
            k = at + int(hit[0])
            low, high = place == j[k], place == i[k]
            place[low], place[high] = i[k], j[k]
            at = k + 1
    return place


def permutation(n: int, seed: int, before: int = 0) -> np.ndarray:
    """The items at all places after the shuffle: one task's work and eight bytes an item, as each swap depends on those before it."""
    out = np.arange(n)
    chunks = range(1, n, CHUNK)
    for a in reversed(chunks):
        b = min(n, a + CHUNK)
        i = np.arange(a, b)
        j = (draws(seed, before + n - b + 1, b - a)[::-1] * (i + 1)).astype(np.int64)
        for x, y in zip(i[::-1].tolist(), j[::-1].tolist(), strict=True):
            out[x], out[y] = out[y], out[x]
    return out


def shuffled(spark: SparkSession, n: int, seed: int, before: int = 0) -> DataFrame:
    """item, place (from 0) of n items after the shuffle, made in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            items = permutation(n, seed, before)
            for a in range(0, n, CHUNK):
                part = items[a : a + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.arange(a, a + len(part)), pa.int64())], names=["item", "place"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "item BIGINT, place BIGINT")
