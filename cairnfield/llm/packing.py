"""Best-fit decreasing packing of token sequences.

Documents longer than a window are cut into full windows first. What remains of
each document is placed, longest first, in the open window with the least room
that still holds it, which a segment tree over the remaining capacities finds in
logarithmic time. Every task packs the rows of its own input split in blocks of
at most `block` pieces, so nothing is shuffled and memory is bounded; a block
leaves at most a few windows open.

Defined results: a null or empty text has only its end id; repeated rows are
packed each for itself, and rows without an id, or with one that is no whole number, have none; ties in length keep the order of the input; an empty table
gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

from . import tokens as K

WINDOW = 2048
BLOCK = 200_000
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


class CapacityTree:
    """Counts of open windows by remaining capacity, with the tightest fit in O(log window)."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least capacity of at least `need`."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.size
        window = self.open[capacity].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each length (1 to `window`), and the number of windows."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.tightest(need)
        if found is None:
            room, at = window, n
            n += 1
        else:
            room, at = found
        where[i], offset[i] = at, window - room
        if room > need:
            tree.add(room - need, at)
    return where, offset, n


class _Block:
    """Pieces gathered until they are packed together."""

    def __init__(self, part: int, window: int, tail: int) -> None:
        self.part, self.window, self.tail, self.sequences = part, window, tail, 0
        self.docs: list[tuple[int | None, np.ndarray]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, np.append(ids.astype("<u4"), np.array([self.tail], "<u4"))))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        size = np.array([len(x) for _, x in self.docs], np.int64)
        full, rest = size // self.window, size % self.window
        some = np.flatnonzero(rest)
        where, offset, n = best_fit_decreasing(rest[some], self.window)
        counts = full + (rest > 0)
        owner = np.repeat(np.arange(len(size)), counts)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * self.window
        length = np.minimum(self.window, size[owner] - start)
        sequence, at = np.empty(len(owner), np.int64), np.zeros(len(owner), np.int64)
        last = length < self.window
        sequence[last], at[last] = where, offset
        sequence[~last] = n + np.arange(int(full.sum()))
        sequence += self.sequences + (self.part << 36)
        self.sequences += n + int(full.sum())
        doc_ids = pa.array([d for d, _ in self.docs], pa.int64())
        for k in range(0, len(owner), 4096):
            own, s, m = owner[k : k + 4096], start[k : k + 4096], length[k : k + 4096]
            ids = pa.array([self.docs[o][1][a : a + b].tobytes() for o, a, b in zip(own.tolist(), s.tolist(), m.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(own)), *map(pa.array, (s, m, size[own], sequence[k : k + 4096], at[k : k + 4096])), ids], schema=_ARROW)
        self.docs = []


def pack(docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 1, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and their places in sequences of at most `window` ids.

    A sequence id joins the number of the task that packed it (upper bits) and a count.
    """
    path = tokenizer or K.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, size = K.encoder(path), 0, 0
        waiting = _Block(TaskContext.get().partitionId(), window, end_id)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in encoder.encode(batch.column(1)):
                bounds = part.bounds.tolist()
                for k in range(len(bounds) - 1):
                    waiting.add(ids[part.first + k], part.ids[bounds[k] : bounds[k + 1]])
                held += len(bounds) - 1
                size += len(part.ids)
                if held >= block or size >= 32_000_000:
                    yield from waiting.flush()
                    held = size = 0
        yield from waiting.flush()

    plain = docs.select(F.col(id_col).try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(scratch.lean(run, "tokens"), SCHEMA)
