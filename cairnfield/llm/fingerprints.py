"""Quartile bucket digests of whole texts and their difference score.

Byte triplets of a sliding window are hashed into 256 buckets; a digest holds the
quartile of each bucket's count (two bits), the ratios of the quartiles, and the
logarithm of the length. Two digests differ by the steps between their quartile
codes, ratios and lengths, bounded by MAX_DIFFERENCE; likeness is one less the
bounded share.

Defined results: null and empty texts have the digest of no triplets and are like
each other; texts shorter than the window are read as if zero bytes followed;
equal texts have equal digests; ids that are no whole numbers are null; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import text as T

BUCKETS = 256
WINDOW = 5
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4))
MAX_DIFFERENCE = 832
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_STEP = np.array([0, 1, 2, 6], np.int64)
DIGEST_BYTES = 3 + BUCKETS // 4


def digests(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of DIGEST_BYTES for each text `raw[bounds[i]:bounds[i + 1]]`."""
    n, sizes, gap = len(bounds) - 1, np.diff(bounds), WINDOW - 1
    padded = np.zeros(len(raw) + n * gap, np.uint8)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    at = np.arange(len(raw), dtype=np.int64) + owner * gap
    padded[at] = raw
    parts = [padded.astype(np.uint32) * m for m in _MULTIPLIERS[:3]]
    counts = np.zeros((n + 1) * BUCKETS, np.int64)
    own = np.full(len(padded), n, np.int64)
    own[at] = owner
    own *= BUCKETS
    span = max(len(padded) - gap, 0)
    for k, (i, j) in enumerate(TRIPLETS):
        h = parts[0][:span] + parts[1][i : i + span]
        h += parts[2][j : j + span]
        h ^= h >> np.uint32(15)
        h *= _MULTIPLIERS[3] + np.uint32(2 * k)
        h >>= np.uint32(24)
        counts += np.bincount(own[:span] + h, minlength=len(counts))
    table = counts[: n * BUCKETS].reshape(n, BUCKETS)
    order = np.sort(table, axis=1)
    q1, q2, q3 = (order[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    codes = (table > q1[:, None]).astype(np.uint8)
    codes += table > q2[:, None]
    codes += table > q3[:, None]
    out = np.zeros((n, DIGEST_BYTES), np.uint8)
    top = np.maximum(q3, 1)
    out[:, 0] = q1 * 255 // top
    out[:, 1] = q2 * 255 // top
    out[:, 2] = np.minimum(255, np.round(8 * np.log2(sizes + 1)))
    quads = codes.reshape(n, -1, 4)
    out[:, 3:] = quads[:, :, 0] << 6 | quads[:, :, 1] << 4 | quads[:, :, 2] << 2 | quads[:, :, 3]
    return out


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference of digests, row by row: 0 to MAX_DIFFERENCE."""
    total = np.zeros(len(a), np.int64)
    for shift in (0, 2, 4, 6):
        total += _STEP[np.abs((a[:, 3:] >> shift & 3).astype(np.int64) - (b[:, 3:] >> shift & 3))].sum(axis=1)
    head = np.abs(a[:, :3].astype(np.int64) - b[:, :3])
    total += head[:, 0] // 8 + head[:, 1] // 8 + head[:, 2]
    return np.minimum(total, MAX_DIFFERENCE)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - difference(a, b) / MAX_DIFFERENCE


def of_texts(texts: list[str]) -> np.ndarray:
    data = [x.encode("utf-8", "replace") for x in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)])
    return digests(np.frombuffer(b"".join(data), np.uint8), bounds)


def hexes(table: np.ndarray) -> list[str]:
    data = table.tobytes().hex()
    width = 2 * table.shape[1]
    return [data[k : k + width] for k in range(0, len(data), width)]


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and the digest (hexadecimal) of every whole text; one pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(hexes(of_texts(texts)))], schema=schema)

    return docs.select(F.col(id_col).try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scratch.lean(run), "doc_id bigint, n_chars bigint, fingerprint string")


def pieces(batch: pa.RecordBatch, limit: int = 1_500_000) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of a batch, a few megabytes at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        value = text.as_py() or ""
        ids.append(doc_id)
        texts.append(value)
        size += len(value)
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


# ---------------------------------------------------------------------------------------------------------------------
# edited texts

_FIELDS = [("part", pa.int32()), ("head", pa.bool_()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string()), ("edited_sha256", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
_SCHEMA = "part int, head boolean, doc_id bigint, n_chars bigint, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double, text string"
RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many first code points of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compare(ids: list[int], texts: list[str], own: np.ndarray, following: list[str], after: np.ndarray) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    digest = of_texts(changed)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array(hexes(own), pa.string()),
        pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in changed], pa.string()),
        pa.array(hexes(digest), pa.string()),
        pa.array(likeness(own, digest), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]


def edit_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of all texts and of their edited texts, with the next document by descending id; after the last comes the first.

    One range shuffle puts the rows in order; each task compares its rows as they
    stream by. The last row of each task waits for the first row of the next task
    with rows: these pairs, one a task, are joined by task number. Rows with the
    same id follow each other by text.
    """
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[int, str, np.ndarray] | None = None
        first = True

        def rows(n: int, columns: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
            nonlocal first
            heads = [first, *[False] * (n - 1)]
            first = False
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(heads), *columns, pa.array(texts, pa.string())], schema=schema)

        for batch in batches:
            for ids, texts in pieces(batch):
                digest = of_texts(texts)
                if held is not None:
                    ids, texts, digest = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], digest])
                held = ids[-1], texts[-1], digest[-1]
                if len(ids) > 1:
                    yield rows(len(ids) - 1, _compare(ids[:-1], texts[:-1], digest[:-1], texts[1:], digest[1:]), [texts[0] if first else None, *[None] * (len(ids) - 2)])
        if held is not None:
            none = [pa.array([None], t) for _, t in _FIELDS[5:9]]
            yield rows(1, [pa.array([held[0]], pa.int64()), pa.array([len(held[1])], pa.int64()), pa.array(hexes(held[2][None])), *none], [held[1]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(k).to_pylist() for k in range(3))
            if ids:
                yield pa.RecordBatch.from_arrays(_compare(ids, texts, of_texts(texts), following, of_texts(following)), schema=pa.schema(_FIELDS[2:9]))

    plain = docs.select(F.col(id_col).try_cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = scratch.partitions(docs.sparkSession)
    ordered = plain.repartitionByRange(n, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "text")
    made = scratch.materialise(ordered.mapInArrow(scratch.lean(run), _SCHEMA), "fingerprints")
    heads = made.filter("head").select("part", F.col("text").alias("following"))
    # one short row a task: the next task with rows, and after the last the first
    by_part = Window.orderBy("part")
    parts = heads.select("part").withColumn("after", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())))
    waiting = made.filter(F.col("edited_sha256").isNull()).select("part", "doc_id", "text").join(F.broadcast(parts), "part")
    pairs = waiting.join(heads.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "following")
    last = pairs.mapInArrow(scratch.lean(finish), ", ".join(_SCHEMA.split(", ")[2:9]))
    return made.filter(F.col("edited_sha256").isNotNull()).select(*RESULT).unionByName(last.select(*RESULT))
