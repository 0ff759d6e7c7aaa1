"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

1. Items are cut into pieces of PASSAGE_WORDS words. Two passes over all documents
   make a randomised singular value decomposition of the TF-IDF matrix of their
   passages on the items' words: the first counts documents by word and multiplies
   the matrix of counts by its transpose and random signs, the second the weighted
   matrix (a power pass). Partial sums of tasks are added up in two levels.
2. The corpus' main directions, with their singular values, and the items' pieces
   are decomposed together; the directions that hold ENERGY of the squares span the
   latent space. A third pass projects overlapping passages of all documents and
   searches by the cosine in that space: only what lies in it counts, so the words
   around a short or reworded copy, which lie outside, don't dilute it.
3. Around every candidate the longest common subsequence of words with the whole
   item decides: `exact` share of the item's words, or `paraphrase` share together
   with ANSWER of the item's answer (its last quarter of words).

Items of fewer than SHORT_WORDS words have no direction of their own; they are found
as exact phrases (those of one or two words only as whole documents). A subsequence
takes clauses in order: of an item whose halves are swapped one half counts.

A pass takes up to PASS_BLOCKS blocks of at most BLOCK_PIECES pieces and BLOCK_WORDS
distinct words, so what is broadcast is bounded; documents are never shuffled.

Defined results: null and empty texts are clean; null items and items without words
are held by none; equal items are found each for itself; items of over ITEM_WORDS
words are searched in parts of that size, each reported for itself; repeated rows
are reported each for itself; an empty benchmark or table gives no leaks; other
columns pass through `decontaminate` and are not read by `leaks`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as T

PASSAGE_WORDS, STRIDE = 48, 24
TOPICS, RANGE, FREQUENT = 32, 40, 256
ENERGY = 0.98
CHUNK_BYTES, PROJECTED_WORDS = 500_000, 16_000
COSINE, EXACT, PARAPHRASE, ANSWER, NEAR_PIECE = 0.55, 0.8, 0.5, 0.25, 0.4
SHORT_WORDS, WHOLE_WORDS, ITEM_WORDS = 8, 3, 10_000
BLOCK_PIECES, BLOCK_WORDS, PASS_BLOCKS = 448, 20_000, 4
SLICE_TERMS, FAN = 256, 16


class Vocabulary:
    """Term numbers of word hashes, by a table without collisions among the terms."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = np.unique(terms)
        bits = max(16, int(len(self.terms) ** 2 // 2).bit_length())
        self.shift, self.salt = np.uint64(64 - min(bits, 24)), np.uint64(1)
        while True:
            place = self.terms * self.salt >> self.shift
            if len(np.unique(place)) == len(place) or self.salt > 2000:
                break
            self.salt += np.uint64(2)
        self.table = np.full(1 << int(64 - self.shift), -1, np.int32)
        self.table[place] = np.arange(len(self.terms))
        # terms that still share a place, if any
        self.extra = np.setdiff1d(np.arange(len(self.terms)), self.table[place])

    def __len__(self) -> int:
        return len(self.terms)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of each hash, or -1."""
        found = self.table[hashes * self.salt >> self.shift]
        if len(self.terms):
            found[self.terms[found] != hashes] = -1
        for k in self.extra.tolist():
            found[hashes == self.terms[k]] = k
        return found


class Items(NamedTuple):
    """A block of items: ids and words; of the longer ones the pieces, with their items, in the items' order."""

    ids: list[int | None]
    words: list[np.ndarray]
    pieces: list[np.ndarray]
    owner: np.ndarray


class Space(NamedTuple):
    """What the search needs of a block of items; its size is bounded by the block."""

    items: Items
    vocabulary: Vocabulary
    project: np.ndarray  # weighted directions: terms x rank
    latent: np.ndarray  # unit vectors of the pieces: rank x pieces
    weight: np.ndarray  # of the terms
    place: np.ndarray  # of each term among the FREQUENT ones, or -1
    frequent: np.ndarray  # rows of `project` of these


def pieces_of(words: np.ndarray) -> list[np.ndarray]:
    """Overlapping pieces of PASSAGE_WORDS words; the last one ends with the item."""
    last = max(0, len(words) - PASSAGE_WORDS)
    return [words[k : k + PASSAGE_WORDS] for k in [*range(0, last, STRIDE), last]]


def _words(text: str) -> np.ndarray:
    found = [T.words(x).hashes for x in T.chunks(pa.array([text], pa.string()))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark's items, a bounded block at a time."""
    rows = benchmark.select(F.col(id_col).try_cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null").orderBy("i", "t")
    ids: list[int | None] = []
    words: list[np.ndarray] = []
    pieces: list[np.ndarray] = []
    owner: list[int] = []
    distinct: set[int] = set()
    for r in rows.toLocalIterator():
        every = _words(r["t"])
        for first in range(0, len(every), ITEM_WORDS):
            part = every[first : first + ITEM_WORDS]
            own = pieces_of(part) if len(part) >= SHORT_WORDS else []
            new = set(part.tolist()) - distinct if own else set()
            if ids and (len(ids) >= 4 * BLOCK_PIECES or len(pieces) + len(own) > BLOCK_PIECES or len(distinct) + len(new) > BLOCK_WORDS):
                yield Items(ids, words, pieces, np.array(owner, np.int64))
                ids, words, pieces, owner, distinct, new = [], [], [], [], set(), set(part.tolist()) if own else set()
            distinct |= new
            owner += [len(ids)] * len(own)
            pieces += own
            ids.append(r["i"])
            words.append(part)
    if ids:
        yield Items(ids, words, pieces, np.array(owner, np.int64))


def passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Items]]:
    """Blocks that one pass over the documents takes."""
    found = blocks(benchmark, id_col, text_col)
    while group := list(islice(found, PASS_BLOCKS)):
        yield group


# ---------------------------------------------------------------------------------------------------------------------
# the decomposition


def _summed(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group (ascending), n rows."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(group):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out[group[first]] = np.add.reduceat(values, first, axis=0)
    return out


def multiplied(term: np.ndarray, passage: np.ndarray, right: np.ndarray, total: np.ndarray) -> None:
    """Adds Aᵀ (A right) to `total`, for the matrix A that counts terms (not -1) by passage (ascending)."""
    known = np.flatnonzero(term >= 0)
    t, p = term[known], passage[known]
    if not len(t):
        return
    _, p = np.unique(p, return_inverse=True)
    left = _summed(right[t], p, int(p[-1]) + 1)
    order = np.argsort(t, kind="stable")
    t = t[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    total[t[first]] += np.add.reduceat(left[p[order]], first, axis=0)


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the rows (k, v) of all tasks, in two levels."""
    n = scratch.partitions(parts.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, g, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(v.as_buffer(), "<f8")
                total[k, g] = total[k, g] + x if (k, g) in total else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["k", "g", "v"])

    schema = "k int, g int, v binary"
    some = parts.repartition(n, "k", "g").mapInArrow(scratch.lean(add), schema)
    found = some.repartition(n, "k").mapInArrow(scratch.lean(add), schema).toArrow()
    return {k: np.frombuffer(v, "<f8") for k, v in zip(found.column(0).to_pylist(), found.column(2).to_pylist(), strict=True)}


def _product(texts: DataFrame, vocabularies: list[Vocabulary], right: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each block Aᵀ A times its matrix over all passages, and documents by term; and the number of documents."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabularies, [x.astype(np.float32) for x in right]))
    schema = pa.schema([("k", pa.int32()), ("g", pa.int32()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies, right = shared.value
        total = [np.zeros((len(v), RANGE)) for v in vocabularies]
        held = [np.zeros(len(v)) for v in vocabularies]
        docs, group = 0, TaskContext.get().partitionId() % FAN
        for batch in batches:
            docs += batch.num_rows
            for chunk in T.chunks(batch.column(0), CHUNK_BYTES):
                found = T.words(chunk)
                count = np.diff(found.bounds)
                row = np.repeat(np.arange(chunk.rows), count)
                inside = T.ranges(np.zeros(len(count), np.int64), count) // PASSAGE_WORDS
                passage = np.cumsum(np.append(0, (inside[1:] != inside[:-1]) | (row[1:] != row[:-1]))) if len(row) else row
                for k, own in enumerate(vocabularies):
                    term = own.numbers(found.hashes)
                    multiplied(term, passage, right[k], total[k])
                    known = np.flatnonzero(term >= 0)
                    held[k] += np.bincount(np.unique(row[known] * len(own) + term[known]) % max(1, len(own)), minlength=len(own))
        out = [(0, np.array([float(docs)]))]
        for k, v in enumerate(vocabularies):
            # multiples of 2**-20, whose sums are exact in any order
            both = np.concatenate([np.round(total[k] * 2.0**20) * 2.0**-20, held[k][:, None]], axis=1).astype("<f8")
            out += [((k + 1) << 20 | i, both[i * SLICE_TERMS : (i + 1) * SLICE_TERMS].reshape(-1)) for i in range(-(-len(v) // SLICE_TERMS))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([group] * len(out), pa.int32()), pa.array([x.tobytes() for _, x in out], pa.binary())], schema=schema)

    found = _added(texts.mapInArrow(scratch.lean(run), "k int, g int, v binary"))
    tables = []
    for k, v in enumerate(vocabularies):
        parts = [found[key].reshape(-1, RANGE + 1) for key in sorted(x for x in found if x >> 20 == k + 1)]
        tables.append(np.concatenate(parts) if parts else np.zeros((len(v), RANGE + 1)))
    return [t[:, :RANGE] for t in tables], [t[:, RANGE] for t in tables], int(found[0][0]) if 0 in found else 0


def _signs(terms: np.ndarray) -> np.ndarray:
    """Random signs that follow from the words, so all runs agree."""
    return np.where(T.mix64(terms)[:, None] >> np.arange(RANGE, dtype=np.uint64) & np.uint64(1), 1.0, -1.0)


def topics(basis: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Main directions times singular values (TOPICS rows at most) of the matrix whose square maps the orthonormal basis to the image."""
    values, vectors = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    some = values > 1e-9 * max(float(values.max(initial=0.0)), 1e-300)
    left, sizes, _ = np.linalg.svd(image @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)
    return (left[:, :TOPICS] * sizes[:TOPICS]).T


def vectors(pieces: list[np.ndarray], vocabulary: Vocabulary, weight: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of word sequences on the vocabulary, as rows."""
    out = np.zeros((len(pieces), len(vocabulary)))
    for k, w in enumerate(pieces):
        term, n = np.unique(vocabulary.numbers(w), return_counts=True)
        out[k, term[term >= 0]] = n[term >= 0]
    out *= weight
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def space(items: Items, vocabulary: Vocabulary, weight: np.ndarray, main: np.ndarray, *, energy: float = ENERGY) -> Space:
    """The latent space of a block: the joint decomposition of the corpus' main directions and the pieces, of equal weight in all."""
    own = vectors(items.pieces, vocabulary, weight)
    size = np.linalg.norm(main)
    stacked = np.concatenate([main * (len(own) ** 0.5 / size) if size > 0 else main, own])
    _, values, right = np.linalg.svd(stacked, full_matrices=False)
    share = np.cumsum(values**2) / max(float((values**2).sum()), 1e-300)
    directions = right[: int(np.searchsorted(share, energy)) + 1].T
    latent = own @ directions
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-300)
    project, place = (directions * weight[:, None]).astype(np.float32), np.full(len(weight), -1)
    often = np.argsort(weight, kind="stable")[:FREQUENT]
    place[often] = np.arange(len(often))
    return Space(items, vocabulary, project, latent.T.astype(np.float32), weight, place, project[often])


def fit(texts: DataFrame, group: list[Items]) -> list[Space]:
    """The latent spaces of the blocks of a pass, from two passes over all texts."""
    vocabularies = [Vocabulary(np.concatenate([*x.pieces, np.zeros(0, np.uint64)])) for x in group]
    images, held, docs = _product(texts, vocabularies, [_signs(v.terms) for v in vocabularies])
    weights = [np.log((docs + 1) / (h + 1)) + 0.1 for h in held]
    bases = [np.linalg.qr(y * w[:, None])[0] for y, w in zip(images, weights, strict=True)]
    bases = [np.pad(b, ((0, 0), (0, RANGE - b.shape[1]))) for b in bases]
    images, _, _ = _product(texts, vocabularies, [b * w[:, None] for b, w in zip(bases, weights, strict=True)])
    return [space(items, v, w, topics(b, y * w[:, None])) for items, v, w, b, y in zip(group, vocabularies, weights, bases, images, strict=True)]


# ---------------------------------------------------------------------------------------------------------------------
# the search


def common_subsequence(pattern: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for k, x in enumerate(pattern.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(pattern)) - 1
    row = full
    for x in text.tolist():
        match = places.get(x, 0)
        if match:
            u = row & match
            row = ((row + u) | (row - u)) & full
    return len(pattern) - row.bit_count()


def judged(item: np.ndarray, words: np.ndarray, least: float) -> tuple[float, float]:
    """Shares of the item and of its answer in the stretch of `words` that holds most of the item; (0, 0) if no stretch can hold `least`."""
    m = len(item)
    if common_subsequence(item, words) < least * m:
        return 0.0, 0.0
    width, step = m + max(4, m // 3), max(1, m // 6)
    best, at = 0, 0
    for start in range(0, max(1, len(words) - width + step), step):
        found = common_subsequence(item, words[start : start + width])
        if found > best:
            best, at = found, start
        if best == m:
            break
    answer = item[m - max(2, m // 4) :]
    return best / m, common_subsequence(answer, words[at : at + width]) / len(answer)


def _stretches(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of the stretches of STRIDE words; a passage is two that follow each other in a row."""
    n = -(-np.diff(bounds) // STRIDE)
    row = np.repeat(np.arange(len(n)), n)
    return row, bounds[:-1][row] + T.ranges(np.zeros(len(n), np.int64), n) * STRIDE


def candidates(found: T.Words, own: Space, cosine: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, first word, end, piece, cosine) of the passages whose latent cosine with a piece reaches `cosine`: of each item the piece nearest to the passage.

    Pieces of at most STRIDE words are also sought in single stretches.
    """
    row, start = _stretches(found.bounds)
    if not len(row) or not len(own.items.pieces):
        return
    term = own.vocabulary.numbers(found.hashes)
    known = np.flatnonzero(term >= 0)
    stretch = np.searchsorted(start, known, "right") - 1
    first = np.flatnonzero(np.append(True, own.items.owner[1:] != own.items.owner[:-1]))
    short = np.array([len(x) <= STRIDE for x in own.items.pieces])
    ends = np.append(start[1:], len(term))
    step = PROJECTED_WORDS // STRIDE
    for lo in range(0, len(row), step):
        hi = min(lo + step + 1, len(row))  # the passage of the last stretch reaches into the next
        a, b = np.searchsorted(stretch, (lo, hi))
        # frequent words are counted and multiplied, the others' rows are added up
        t, at = term[known[a:b]], stretch[a:b] - lo
        slot, width = own.place[t], len(own.frequent)
        often, seldom = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        alone = np.bincount(at[often] * width + slot[often], minlength=(hi - lo) * width).reshape(hi - lo, width).astype(np.float32) @ own.frequent
        alone += _summed(own.project[t[seldom]], at[seldom], hi - lo)
        follows = np.append(row[lo + 1 : hi] == row[lo : hi - 1], False)
        whole = alone.copy()
        whole[:-1][follows[:-1]] += alone[1:][follows[:-1]]
        n = min(step, hi - lo)
        # the last stretch of a row stands in the passage before it
        lone = np.append(True, row[1:] != row[:-1])[lo : lo + n]
        for vectors_, columns, size in ((whole[:n], np.ones(len(short), bool), 2), (alone[:n], short, 1)):
            if not columns.any():
                continue
            norm = np.linalg.norm(vectors_, axis=1)
            near = vectors_ @ own.latent
            near /= np.maximum(norm, 1e-20)[:, None]
            near[:, ~columns] = -1
            if size == 2:
                near[~(follows[:n] | lone)] = -1
            best = np.maximum.reduceat(near, first, axis=1)
            for k, i in zip(*(x.tolist() for x in np.nonzero(best >= cosine)), strict=True):
                c0, c1 = int(first[i]), int(first[i + 1]) if i + 1 < len(first) else len(short)
                end = int(ends[lo + k + 1] if size == 2 and follows[k] else ends[lo + k])
                yield int(row[lo + k]), int(start[lo + k]), end, c0 + int(near[k, c0:c1].argmax()), float(best[k, i])


def phrases(found: T.Words, items: Items) -> Iterator[tuple[int, int]]:
    """(row, item) of the short items that stand word by word in a row; the shortest must be all of it."""
    count = np.diff(found.bounds)
    for size in sorted({len(w) for w in items.words if 0 < len(w) < SHORT_WORDS}):
        hashes, bounds = T.shingles(found.hashes, found.bounds, size)
        row = np.repeat(np.arange(len(count)), np.diff(bounds))
        some = (count[row] == size) if size < WHOLE_WORDS else (count[row] >= size)
        hashes, row = hashes[some], row[some]
        for i, w in enumerate(items.words):
            if len(w) == size:
                own, _ = T.shingles(w, np.array([0, size]), size)
                for r in np.unique(row[hashes == own[0]]).tolist():
                    yield r, i


def search(chunk: T.Chunk, own: Space, *, cosine: float, exact: float, paraphrase: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item, cosine, share, answer share) of the leaks in a chunk, the best for each row and item."""
    found = T.words(chunk)
    best: dict[tuple[int, int], tuple[float, float, float]] = {x: (1.0, 1.0, 1.0) for x in phrases(found, own.items)}
    for r, a, b, piece, likeness in candidates(found, own, cosine):
        item = int(own.items.owner[piece])
        if best.get((r, item), (0.0, 0.0, 0.0))[1] >= exact:
            continue
        words, part = own.items.words[item], own.items.pieces[piece]
        begin, end = int(found.bounds[r]), int(found.bounds[r + 1])
        if len(part) < len(words) and common_subsequence(part, found.hashes[max(begin, a - STRIDE) : min(end, b + STRIDE)]) < NEAR_PIECE * len(part):
            continue
        share, answer = judged(words, found.hashes[max(begin, a - len(words)) : min(end, b + len(words))], min(exact, paraphrase))
        if share >= exact or share >= paraphrase and answer >= ANSWER:
            best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (likeness, share, answer), key=lambda x: x[1])
    return [(r, item, *x) for (r, item), x in sorted(best.items())]


def _searched(docs: DataFrame, texts: DataFrame, group: list[Items], schema, made: Callable, **thresholds) -> DataFrame:
    """Rows that `made` yields from each batch and the spaces of a pass."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from made(batch, shared.value, thresholds)

    return docs.mapInArrow(scratch.lean(run), schema)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE, exact: float = EXACT, paraphrase: float = PARAPHRASE) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share for each document and each item it holds."""
    schema = "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double"
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((n, pa.float64()) for n in ("cosine", "lcs_share", "answer_share"))])
    plain = docs.select(F.col(id_col).try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def made(batch: pa.RecordBatch, spaces: list[Space], thresholds: dict) -> Iterator[pa.RecordBatch]:
        for chunk in T.chunks(batch.column(1), CHUNK_BYTES):
            for own in spaces:
                found = search(chunk, own, **thresholds)
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([chunk.first + x[0] for x in found])), pa.array([own.items.ids[x[1]] for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.float64()) for k in (2, 3, 4))], schema=arrow)

    out = docs.sparkSession.createDataFrame([], schema)
    for group in passes(benchmark, item_id_col, item_text_col):
        out = out.unionByName(_searched(plain, plain.select("text"), group, schema, made, cosine=cosine, exact=exact, paraphrase=paraphrase))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE, exact: float = EXACT, paraphrase: float = PARAPHRASE) -> DataFrame:
    """The rows of `docs` that hold no item; every pass filters where the rows are, without a join."""
    out, at = docs, docs.columns.index(text_col)

    def made(batch: pa.RecordBatch, spaces: list[Space], thresholds: dict) -> Iterator[pa.RecordBatch]:
        clean = np.ones(batch.num_rows, bool)
        for chunk in T.chunks(batch.column(at), CHUNK_BYTES):
            for own in spaces:
                for x in search(chunk, own, **thresholds):
                    clean[chunk.first + x[0]] = False
        yield batch.filter(pa.array(clean))

    for group in passes(benchmark, item_id_col, item_text_col):
        out = _searched(out, docs.select(F.col(text_col).cast("string").alias("text")), group, docs.schema, made, cosine=cosine, exact=exact, paraphrase=paraphrase)
    return out
