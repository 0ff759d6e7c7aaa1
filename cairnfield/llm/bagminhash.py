"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets.

Every shingle with count w owns independent Poisson processes over the weight
intervals [0, 1), [1, 2), [2, 4), [4, 8), ...: a process of an interval has the
interval's width as its rate, and each of its points carries a slot and a weight
inside the interval. A point takes part if its weight is below w, so the processes
of larger weights contain those of smaller ones, and the first point of a slot is
shared by two documents with the probability of their weighted Jaccard similarity.
Points are made only up to the time at which all slots of the document are filled.

Signatures are banded; documents that share a band are candidates. Equal word
sequences are one node from the start. In each bucket all nodes are compared with
its first and its last one. A sketch of four bits a slot passes over pairs whose
estimated similarity lies 5.5 standard deviations below the threshold; the others
are verified by the exact overlap of multisets. Then all members of a bucket that
are still in different classes are compared too, so no link between classes is
lost: sketches tie those members together that may be links, and what is tied is
compared in blocks inside of tasks, by sketches and then by multisets. No pair of
members of a bucket is a row.

A batch of rows sends only the first of its members of a bucket to that bucket,
and the others are compared with that one, so a hot bucket holds as many rows as
there are batches, not documents.

Defined results: null is the empty text; texts of fewer words than a shingle are
one shingle; texts without words are alike only if they are equal; repeated rows
(also of one id) are in one class if their texts are alike; rows without an id, or
with one that is no number, are classed like others under a null id; the class id
is its least doc_id, or null if none of its rows has one; an empty table gives an
empty table; other columns, whatever their names, are not read.

Rows are told apart by 128 bits of id and text, and so are word sequences: nodes are
64-bit keys, and keys that two word sequences share are split by 64 further bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as T

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 40, 6
SLOTS = BANDS * BAND_ROWS
CHUNK_BYTES = 1_000_000
FILTER_BITS = 1 << 26
SKETCH_BYTES = SLOTS // 2
SKETCH_DEVIATIONS = 5.5  # a pair at the threshold is missed with a probability of 2e-8
BUCKET_BLOCK = 2000
BLOCK_MEMBERS, BLOCK_BYTES = 1000, 16 << 20
BROADCAST_ROWS = 300_000  # a table of so many keys and numbers is at most 12 MB
SALTS = 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def multiset(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) with their counts, ordered by row."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], r[first], np.diff(np.append(first, len(h)))


def _points(seed: np.ndarray, width: np.ndarray, lower: np.ndarray, weight: np.ndarray, row: np.ndarray, limit: np.ndarray, best: np.ndarray) -> None:
    """Puts the points of processes up to their rows' time limits into `best` (least time by row and slot)."""
    expected = np.maximum(width * limit[row], 0.5)
    block = np.ceil(2 ** (np.ceil(2 * np.log2(expected + 1.5)) / 2)).astype(np.int64)
    np.minimum(block, 4096, out=block)
    for size in np.unique(block).tolist():
        members = np.flatnonzero(block == size)
        step = max(1, 300_000 // size)
        for k in range(0, len(members), step):
            at = members[k : k + step]
            base, draw = np.zeros(len(at)), 0
            while len(at):
                counter = (np.arange(draw, draw + size, dtype=np.uint64) + np.uint64(1)) * _STEP
                h = T.mix64(seed[at][:, None] + counter)
                x = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
                np.log(x, out=x)
                x /= -width[at][:, None]
                x[:, 0] += base
                np.cumsum(x, axis=1, out=x)
                i, j = np.nonzero(x <= limit[row[at]][:, None])
                if len(i):
                    other = T.mix64(h[i, j] ^ np.uint64(0xD1B54A32D192ED03))
                    own = at[i]
                    place = lower[own] + width[own] * ((other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
                    taken = place < weight[own]
                    slot = ((other >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype(np.int64)
                    np.minimum.at(best, (row[own] * SLOTS + slot)[taken], x[i, j][taken])
                more = x[:, -1] <= limit[row[at]]
                at, base, draw = at[more], x[more, -1], draw + size


def signatures(hashes: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """The least time of each slot (rows x SLOTS) of weighted sets; infinite for rows without elements."""
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(hashes)), levels)
    level = T.ranges(np.zeros(len(levels), np.int64), levels)
    lower = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    seed = T.mix64(hashes[element] + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    own, w = row[element], weight[element].astype(float)
    rate = np.bincount(row, weights=weight, minlength=rows)
    best = np.full(rows * SLOTS, np.inf)
    open_rows = rate > 0
    extra = 3.0
    while open_rows.any():
        limit = np.where(open_rows, (np.log(SLOTS) + extra) * SLOTS / np.maximum(rate, 1), -1.0)
        some = open_rows[own]
        _points(seed[some], width[some], lower[some], w[some], own[some], limit, best)
        open_rows &= np.isinf(best.reshape(rows, SLOTS)).any(axis=1)
        extra += 9.0
    return best.reshape(rows, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each row and band, of which equal ones mark candidates."""
    parts = signature.view(np.uint64).reshape(len(signature), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = T.mix64(key * _STEP + parts[:, :, k])
    return key


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each slot, two slots a byte."""
    low = (T.mix64(signature.view(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return low[:, 0::2] << 4 | low[:, 1::2]


def nodes(chunk: T.Chunk, found: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's word sequence, or of its text if there is no word."""
    count = np.diff(found.bounds)
    at = T.ranges(np.zeros(len(count), np.int64), count).astype(np.uint64) + np.uint64(1)

    def keyed(salt: int) -> np.ndarray:
        total = np.concatenate([[np.uint64(0)], np.cumsum(T.mix64(found.hashes ^ T.mix64(at * np.uint64(salt))), dtype=np.uint64)])
        return T.mix64(total[found.bounds[1:]] - total[found.bounds[:-1]] + T.mix64(count.astype(np.uint64) + np.uint64(salt)))

    node, check = keyed(0x9E3779B97F4A7C15), keyed(0xC2B2AE3D27D4EB4F)
    for k in np.flatnonzero(count == 0).tolist():
        raw = chunk.cps[chunk.bounds[k] : chunk.bounds[k + 1]].tobytes()
        node[k], check[k] = np.frombuffer(hashlib.blake2b(b"no words" + raw, digest_size=16).digest(), np.uint64)
    return node.view(np.int64), check.view(np.int64)


def _row_key(id_col: Column, text: Column) -> list[Column]:
    """128 bits of a row's id (as text) and text."""
    own = [id_col.isNull(), F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    return [F.xxhash64(*own).alias("row_key"), F.xxhash64(F.lit("check"), *own).alias("row_check")]


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*_row_key(F.col(id_col), text), text.alias("text"), F.col(id_col).try_cast("bigint").alias("doc_id"))


_SIGNED = "row_key bigint, row_check bigint, doc_id bigint, raw bigint, check bigint, bands array<bigint>, sketch binary"


def sign(docs: DataFrame) -> DataFrame:
    """Keys, bands and sketch of every whole text; in each task only the first row of a word sequence carries the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for chunk in T.chunks(batch.column(2), CHUNK_BYTES):
                found = T.words(chunk)
                hashes, bounds = T.shingles(found.hashes, found.bounds, SHINGLE_WORDS)
                row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
                signature = signatures(*multiset(hashes, row), chunk.rows)
                raw, check = nodes(chunk, found)
                some = np.diff(bounds) > 0
                for k, x in enumerate(zip(raw.tolist(), check.tolist(), strict=True)):
                    some[k] &= x not in seen
                    seen.add(x)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(band_keys(signature[some]).reshape(-1).view(np.int64)))
                made = np.zeros((chunk.rows, SKETCH_BYTES), np.uint8)
                made[some] = sketches(signature[some])
                sketch = pa.array([x.tobytes() if there else None for x, there in zip(made, some.tolist(), strict=True)], pa.binary())
                own = [batch.column(c).slice(chunk.first, chunk.rows) for c in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(raw), pa.array(check), lists, sketch], names=[x.split()[0] for x in _SIGNED.split(", ")])

    return docs.select("row_key", "row_check", "text", "doc_id").mapInArrow(scratch.lean(run), _SIGNED)


def _with_nodes(signed: DataFrame) -> DataFrame:
    """Adds `node`: the raw key, or another one where two word sequences share it."""
    clash = scratch.materialise(signed.groupBy("raw").agg(F.min("check").alias("first_check"), F.max("check").alias("last_check")).filter("first_check <> last_check").select("raw", "first_check"), "clashes")
    n = clash.count()
    if not n:
        return signed.withColumn("node", F.col("raw"))
    told = looked_up(signed, clash, "raw", n)
    return told.withColumn("node", F.when(F.col("first_check") != F.col("check"), F.xxhash64("raw", "check")).otherwise(F.col("raw"))).drop("first_check")


def looked_up(rows: DataFrame, table: DataFrame, key: str | list[str], n: int) -> DataFrame:
    """Left join of rows with a table of `n` distinct keys: broadcast if that is small, else salted, as keys may be hot."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, [*([key] if isinstance(key, str) else key), "_salt"], "left").drop("_salt")


def _placed(signed: DataFrame) -> DataFrame:
    """band, node, via: the least node of the same band in a batch of rows, itself if it is the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            band = lists.flatten().to_numpy(zero_copy_only=False)
            node = np.repeat(batch.column(1).to_numpy(), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((node, band))
            band, node = band[order], node[order]
            new = np.append(True, band[1:] != band[:-1]) if len(band) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            keep = new.copy()
            keep[1:] |= node[1:] != node[:-1]
            via = node[first][np.cumsum(new) - 1] if len(first) else node
            yield pa.RecordBatch.from_arrays([pa.array(band[keep]), pa.array(node[keep]), pa.array(via[keep])], names=["band", "node", "via"])

    return signed.filter(F.size("bands") > 0).select("bands", "node").mapInArrow(scratch.lean(run), "band bigint, node bigint, via bigint")


def units(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distinct keys of the copies of each multiset element, in the order of rows: equal multisets have equal sets."""
    h, _, count = multiset(hashes, row)
    copy = T.ranges(np.zeros(len(count), np.int64), count).astype(np.uint64)
    return T.mix64(np.repeat(h, count) + copy * _STEP)


def _filter_of(spark, ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size in which the hashed ids are set; others may be set too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_places(batch.column(0))] = True
        some = np.flatnonzero(np.packbits(bits))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.packbits(bits)[some].astype(np.int32))], names=["at", "byte"])

    table = np.zeros(FILTER_BITS // 8, np.uint8)
    found = ids.mapInArrow(scratch.lean(run), "at bigint, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return table


def _places(ids: pa.Array) -> np.ndarray:
    return (T.mix64(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, units of the rows `wanted` (row_key, raw, check, node); others are passed over by a filter of fixed size, and any that slip through are joined away."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(docs.sparkSession, wanted.select("row_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0))
            some = np.flatnonzero(bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            if not len(some):
                continue
            picked = batch.take(pa.array(some))
            for chunk in T.chunks(picked.column(1), CHUNK_BYTES):
                found = T.words(chunk)
                hashes, bounds = T.shingles(found.hashes, found.bounds, SHINGLE_WORDS)
                keys = units(hashes, np.repeat(np.arange(chunk.rows), np.diff(bounds)))
                raw = keys.tobytes()
                data = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                own, check = nodes(chunk, found)
                yield pa.RecordBatch.from_arrays([picked.column(0).slice(chunk.first, chunk.rows), pa.array(own), pa.array(check), pa.array(data, pa.binary())], names=["row_key", "raw", "check", "units"])

    made = docs.select("row_key", "text").mapInArrow(scratch.lean(run), "row_key bigint, raw bigint, check bigint, units binary")
    return made.join(wanted, ["row_key", "raw", "check"]).dropDuplicates(["node"]).select("node", "units")


def equal_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of equal slots of each pair of sketches (rows of a x rows of b)."""
    x, y = (np.ascontiguousarray(np.concatenate([s >> 4, s & 15], axis=1).T) for s in (a, b))
    out = np.zeros((len(a), len(b)), np.uint8)
    for s, t in zip(x, y, strict=True):
        out += s[:, None] == t
    return out


def least_slots(threshold: float) -> int:
    """Equal slots that a pair of the threshold's similarity has, less SKETCH_DEVIATIONS."""
    share = threshold + (1 - threshold) / 16
    return int(SLOTS * share - SKETCH_DEVIATIONS * (SLOTS * share * (1 - share)) ** 0.5)


def _table(sketch: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, SKETCH_BYTES)


def hopeful(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule the threshold out."""
    least = least_slots(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _table(batch.column(2)), _table(batch.column(3))
            differ = x ^ y
            equal = ((differ & 0xF0) == 0).sum(axis=1) + ((differ & 0x0F) == 0).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(equal >= least))

    left, right = (sketch.select(F.col("node").alias(n), F.col("sketch").alias(f"s{n}")) for n in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(scratch.lean(run), "a bigint, b bigint")


def similarity(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _near(a: bytes, b: bytes, threshold: float) -> bool:
    least, most = sorted((len(a), len(b)))
    return least >= threshold * most and similarity(a, b) >= threshold


def verified(pairs: DataFrame, content: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by the threshold at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = x.as_buffer(), y.as_buffer()
                keep.append(_near(a, b, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = content.select(F.col("node").alias("a"), F.col("units").alias("ua"))
    right = content.select(F.col("node").alias("b"), F.col("units").alias("ub"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub")
    return both.mapInArrow(scratch.lean(run), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of the links (a, b).

    In each round every node moves to its least neighbour or stays, and the links
    are drawn between the places reached; equal links, and those inside of a place,
    go. A star is gone after one round, and as nodes are hashes, any graph shrinks by a
    share in each. Rounds are written, and only counts reach the driver.
    """
    spark = links.sparkSession
    with scratch.scope(spark):
        edges = scratch.materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
        while True:
            step = scratch.materialise(edges.groupBy("a").agg(F.min("b").alias("to")), "steps")
            n = step.count()
            if not n:
                return scratch.materialise(labels, "labels", outer=True)
            moved = looked_up(labels, step.withColumnRenamed("a", "label"), "label", n)
            labels = scratch.materialise(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
            ends = looked_up(looked_up(edges, step, "a", n).select(F.col("to").alias("x"), "b"), step.select(F.col("a").alias("b"), F.col("to").alias("below")), "b", n)
            places = ends.select("x", F.coalesce("below", "b").alias("y")).filter("x <> y")
            edges = scratch.materialise(places.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")


_ZERO_HALVES = np.array([(x & 0xF0 == 0) + (x & 0x0F == 0) for x in range(256)], np.uint8)


def _pairs_of_small(group: np.ndarray, label: np.ndarray, sketch: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the open pairs inside of each group of consecutive rows, all groups at once."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    start = np.repeat(first, np.diff(np.append(first, len(group))))
    before = np.arange(len(group)) - start
    total = np.cumsum(before)
    lo = 0
    while lo < len(group):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 200_000, "right")))
        left, right = np.repeat(np.arange(lo, hi), before[lo:hi]), T.ranges(start[lo:hi], before[lo:hi])
        differ = label[left] != label[right]
        left, right = left[differ], right[differ]
        some = _ZERO_HALVES[sketch[left] ^ sketch[right]].sum(axis=1, dtype=np.int64) >= least
        yield left[some], right[some]
        lo = hi


def _pairs_of_large(label: np.ndarray, second: np.ndarray, sketch: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the open pairs between two blocks of a bucket (rows of the second are marked), or inside of its only one."""
    values, counts = np.unique(label, return_counts=True)
    rare = label != values[counts.argmax()]  # of the largest label's members no two need a comparison
    if second.any() and not second.all():
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        sides = [(left[rare[left]], right), (left[~rare[left]], right[rare[right]])]
    else:
        sides = [(np.flatnonzero(rare), np.arange(len(label)))]
    for x, y in sides:
        for k in range(0, len(x), 256):
            part = x[k : k + 256]
            i, j = np.nonzero((equal_slots(sketch[part], sketch[y]) >= least) & (label[part][:, None] != label[y]))
            yield part[i], y[j]


def forest(pairs: np.ndarray) -> np.ndarray:
    """Rows of `pairs` that connect the same values with fewer links than there are values."""
    values, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(-1, 2)
    root, kept, at = np.arange(len(values)), [np.zeros(0, np.int64)], np.arange(len(pairs))
    while len(at):
        both = np.sort(root[ends[at]], axis=1)
        at, both = at[both[:, 0] != both[:, 1]], both[both[:, 0] != both[:, 1]]
        order = np.lexsort((both[:, 0], both[:, 1]))
        first = order[np.flatnonzero(np.append(True, np.diff(both[order, 1]) != 0))] if len(order) else order
        kept.append(at[first])
        parent = np.arange(len(values))
        parent[both[first, 1]] = both[first, 0]  # each place moves to a lower one
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]
    return pairs[np.concatenate(kept)]


def open_ties(placed: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """Ties (a, b) between members (band, node, label) of a bucket with different labels that their sketches leave open: of all such pairs a forest that connects the same members.

    Large buckets are compared block by block, and no more ties leave a task than it has members.
    """
    least, schema = least_slots(threshold), "a bigint, b bigint"
    mixed = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("band", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks"))
    member = placed.join(mixed, "band").join(sketch, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = sent.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", (F.col("block") > F.col("other")).alias("second"), "sketch")
    ordered = keyed.repartition(scratch.partitions(placed.sparkSession), "band", "i", "j").sortWithinPartitions("band", "i", "j")

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, label, second = (rows.column(k).to_numpy() for k in (3, 4, 5))
        key = [rows.column(k).to_numpy() for k in range(3)]
        new = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))
        group, table = np.cumsum(new), _table(rows.column(6))
        bounds = np.append(np.flatnonzero(new), len(node))
        size = np.diff(bounds)
        small = np.flatnonzero((size <= 64)[group - 1])
        found = [(small[x], small[y]) for x, y in _pairs_of_small(group[small], label[small], table[small], least)] if len(small) else []
        for k in np.flatnonzero(size > 64).tolist():
            at = slice(bounds[k], bounds[k + 1])
            found += [(x + bounds[k], y + bounds[k]) for x, y in _pairs_of_large(label[at], second[at], table[at], least)]
        if found:
            both = np.sort(np.stack([node[np.concatenate([x[k] for x in found])] for k in (0, 1)], axis=1), axis=1)
            both = forest(both)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole groups, and the last one, which may go on
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 2 * BUCKET_BLOCK:
                rows = pa.Table.from_batches(held).combine_chunks()
                key = [rows.column(k).to_numpy() for k in range(3)]
                last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from compared(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
        if n:
            yield from compared(pa.Table.from_batches(held).combine_chunks())

    return ordered.mapInArrow(scratch.lean(run), schema).distinct()


def verified_in_blocks(ties: DataFrame, labels: DataFrame, sketch: DataFrame, content: DataFrame, threshold: float) -> DataFrame:
    """Links between different labels of the members that ties connect, enough of them to join all labels that belong together.

    Such members are one cluster, dealt into blocks of bounded size; a task gets the
    sketches and multisets of two blocks and compares their members. No pair is a row.
    """
    least = least_slots(threshold)
    cluster = components(ties).withColumnRenamed("label", "cluster")
    sized = scratch.materialise(cluster.join(content.select("node", F.length("units").alias("bytes")), "node").join(labels, "node", "left").select("node", "cluster", F.coalesce("label", "node").alias("label"), "bytes"), "clusters")
    blocks = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = sized.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = dealt.join(content, "node").join(sketch, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = sent.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", (F.col("block") > F.col("other")).alias("second"), "sketch", "units")

    def run(held: pa.Table) -> pa.Table:
        node, label, second = (held.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in ("node", "label", "second"))
        units = [x.as_buffer() for x in held.column("units")]
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for x, y in _pairs_of_large(label, second, _table(held.column("sketch")), least):
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                one, two = find(int(label[a])), find(int(label[b]))
                if one != two and _near(units[a], units[b], threshold):
                    root[one] = two
                    out.append((int(node[a]), int(node[b])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return keyed.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _labels(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """Keyed rows with their nodes; node, label, n_links of the nodes with links, and their number."""
    plain = _plain(docs, id_col, text_col)
    signed = scratch.materialise(sign(plain), "signed")
    signed = _with_nodes(signed)
    # one shuffle by band serves all that follows
    placed = _placed(signed)
    heads = placed.filter("node = via").select("band", "node").repartition(scratch.partitions(docs.sparkSession), "band").dropDuplicates(["band", "node"])
    ends = heads.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    # members of a batch's bucket stand with its least one, which stands for them in the whole bucket
    beside = placed.filter("node <> via").select("band", F.explode(F.array("node", "via")).alias("node"), F.col("via").alias("first"), F.col("via").alias("last"))
    shared = scratch.materialise(heads.join(ends, "band").unionByName(beside), "buckets")
    stars = shared.select("node", F.explode(F.array("first", "last")).alias("other")).filter("node <> other")
    pairs = scratch.materialise(stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
    candidates = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.materialise(signed.filter("sketch is not null").join(candidates, "node").groupBy("node").agg(F.min_by(F.struct("row_key", "raw", "check", "sketch"), "row_key").alias("x")).select("node", "x.*"), "candidates")
    content = scratch.materialise(contents(plain, wanted.drop("sketch")), "contents")
    sketch = wanted.select("node", "sketch")
    links = scratch.materialise(verified(hopeful(pairs, sketch, threshold), content, threshold), "links")
    labels = components(links)
    members = shared.select("band", "node").distinct()
    told = looked_up(members, labels, "node", labels.count()).select("band", "node", F.coalesce("label", "node").alias("label"))
    ties = scratch.materialise(open_ties(told, sketch, threshold), "open")
    if ties.limit(1).count():
        more = scratch.materialise(verified_in_blocks(ties, labels, sketch, content, threshold), "links")
        links = links.unionByName(more)
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b").unionByName(more))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    found = scratch.materialise(labels.join(degree, "node", "left").select("node", "label", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return signed.select("row_key", "row_check", "doc_id", "node"), found, found.count()


def _labelled(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """row_key, row_check, doc_id, label and n_links for every row."""
    rows, classes, n = _labels(docs, id_col, text_col, threshold)
    return looked_up(rows, classes, "node", n).select("row_key", "row_check", "doc_id", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size for every row, and n_links: the verified links of its text with other texts that hold its class together."""
    with scratch.scope(docs.sparkSession):
        member = scratch.materialise(_labelled(docs, id_col, text_col, threshold).drop("row_key", "row_check"), "members")
        classes = scratch.materialise(member.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).filter("class_size > 1"), "sizes")
        both = looked_up(member, classes, "label", classes.count())
        return scratch.materialise(both.select("doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"), "n_links"), "near-duplicates", outer=True)


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One of the rows of `docs` of each class, all columns unchanged: of the least id (none comes last), and of several of it that of the least key."""
    keys = ["row_key", "row_check"]
    with scratch.scope(docs.sparkSession):
        member = scratch.materialise(_labelled(docs, id_col, text_col, threshold).drop("n_links"), "members")
        classes = scratch.materialise(member.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        several = scratch.materialise(looked_up(member, classes, "label", classes.count()).filter("n is not null").drop("n"), "several")
        first = several.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("first"))
        winner = scratch.materialise(first.select(*(F.col(f"first.{k}").alias(k) for k in keys)), "winners")
        dropped = scratch.materialise(several.select(*keys).distinct().join(winner, keys, "left_anti"), "dropped", outer=True)
        repeated = scratch.materialise(several.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").join(winner, keys, "left_semi").select(*keys), "repeated", outer=True)
        n, again = dropped.count(), repeated.count()
    keyed = docs.select(F.struct("*").alias("row"), *_row_key(F.col(id_col), F.col(text_col).cast("string")))
    kept = keyed.join(F.broadcast(dropped) if n <= BROADCAST_ROWS else dropped, keys, "left_anti")
    if again:
        table = F.broadcast(repeated) if again <= BROADCAST_ROWS else repeated
        kept = kept.join(table, keys, "left_anti").unionByName(kept.join(table, keys, "left_semi").dropDuplicates(keys))
    return kept.select("row.*")
