"""Alignment of two tokenizers by a dictionary of groups.

Each text is encoded by both tokenizers. Where a token of A and one of B end at
the same byte, the text is cut; the ids between two cuts are a group, written
`a1,a2|b1`. Tasks intern the groups of a block of documents: a document keeps
the codes of its distinct groups with their counts, and the block's dictionary
gives each code its group, frequency and number of documents. Links (the tokens
that end a group together) are then expanded once per distinct group and
weighted by its frequency, counted over the corpus, and joined back to the
blocks' dictionaries by group; a block's documents meet its dictionary to sum
up. No row is made per occurrence, and what a task holds is bounded by a block.

Defined results: texts that are null or empty, or whose tokens' bytes, joined,
differ from a space and the text, have no tokens: zeros and an empty digest;
strings of special tokens are plain text; repeated rows count as often as they
occur; ids that are no whole numbers are null; an empty table gives an empty
table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import text as T
from . import tokens as K

PIECES = "piece_bpe_32k.model"
BLOCK_CODES, BLOCK_GROUPS = 4_000_000, 500_000
PART_CHARS = 100_000
MARK = "▁"
_SPACE, _NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ENCODED = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("codes", pa.binary()), ("times", pa.binary())]
    + [("code", pa.int32()), ("group", pa.string()), ("freq", pa.int64()), ("docs", pa.int64())]
)
ENCODED_SCHEMA = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, codes binary, times binary, code int, group string, freq bigint, docs bigint"


class Flat:
    """Byte strings by number, side by side."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[T.ranges(self.start[ids], self.size[ids])]


@cache
def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: byte-level BPE of a space and the text, added tokens being plain text."""

    def __init__(self, path: str) -> None:
        self.encoder = K.Encoder(path)
        tokenizer, table = self.encoder.tokenizer, byte_of_char()
        entries = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        self.bytes = Flat([bytes(table[c] for c in x) if all(c in table for c in x) else x.encode() for x in entries])

    def encode(self, chunk: T.Chunk) -> K.Encoded:
        return self.encoder.encode_pretokens(chunk)


class Pieces:
    """Tokenizer B: pieces with byte fallback, with a space put before the text by the model.

    Where no piece has a space after another character, none spans the start of a run of spaces, so long texts are
    encoded in parts cut there, which gives the same ids in bounded memory.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = Flat([bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)])
        self.cuttable = not any(MARK in x.lstrip(MARK) for x in pieces)

    def parts(self, text: str) -> list[str]:
        """Texts whose ids, joined, are those of the text: each but the first has lost the space that the model puts back."""
        out, at = [], 0
        while self.cuttable and len(text) - at > PART_CHARS:
            cut = text.find(" ", at + PART_CHARS)
            while cut > 0 and text[cut - 1] in (" ", MARK):
                cut = text.find(" ", cut + 1)
            if cut <= 0 or cut + 1 == len(text):  # the model puts no space before an empty part
                break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and their bounds."""
        cut = [self.parts(x) for x in texts]
        found = self.model.encode([p for x in cut for p in x], num_threads=1)
        flat = np.fromiter((i for x in found for i in x), np.int32, sum(map(len, found)))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return flat, ends[np.concatenate([[0], np.cumsum([len(x) for x in cut])])]


_pairs: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}
scratch.CACHES["alignment"] = _pairs


def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """One pair per worker."""
    if (a, b) not in _pairs:
        _pairs[a, b] = ByteLevel(a), Pieces(b)
    return _pairs[a, b]


def _rows_equal(data: np.ndarray, ends: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row: data between its ends equals raw between its bounds."""
    size, want = np.diff(ends), np.diff(bounds)
    same = size == want
    at, n = np.flatnonzero(same), want[same]
    differ = data[T.ranges(ends[at], n)] != raw[T.ranges(bounds[at], n)]
    total = np.concatenate([[0], np.cumsum(differ)])
    stop = np.cumsum(n)
    same[at] = total[stop] == total[stop - n]
    return same


def _picked(ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some rows, and their counts."""
    n = bounds[rows + 1] - bounds[rows]
    return ids[T.ranges(bounds[rows], n)].astype(np.int64), n


def _run_hashes(ids: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = size.astype(np.uint64)
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        out[here] = T.mix64(out[here] * _MULTIPLIER + ids[starts[here] + k].astype(np.uint64) + np.uint64(1))
    return out


class Block:
    """Documents whose groups share one dictionary."""

    def __init__(self, number: int, limits: tuple[int, int]) -> None:
        self.number, self.used, self.limits = number, 0, limits
        self.known: dict[tuple[int, int], int] = {}
        self.groups: list[str] = []
        self.freq = np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)

    def codes(self, a: np.ndarray, b: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
        """Code of each group of a chunk; new ones are written down. A group is known by two hashes of 64 bits."""
        ha, hb = _run_hashes(a, a_start, a_size), _run_hashes(b, b_start, b_size)
        code_a, _ = pd.factorize(ha)
        code_b, own_b = pd.factorize(hb)
        code, distinct = pd.factorize(code_a * len(own_b) + code_b)
        where = np.empty(len(distinct), np.int64)
        where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        out = np.empty(len(distinct), np.int64)
        for k, (i, x, y) in enumerate(zip(where.tolist(), ha[where].tolist(), hb[where].tolist(), strict=True)):
            found = self.known.get((x, y))
            if found is None:
                found = self.known[x, y] = len(self.groups)
                ids_a, ids_b = a[a_start[i] : a_start[i] + a_size[i]].tolist(), b[b_start[i] : b_start[i] + b_size[i]].tolist()
                self.groups.append(",".join(map(str, ids_a)) + "|" + ",".join(map(str, ids_b)))
            out[k] = found
        if len(self.groups) > len(self.freq):
            more = np.zeros(max(len(self.groups), 2 * len(self.freq)) - len(self.freq), np.int64)
            self.freq, self.docs = np.concatenate([self.freq, more]), np.concatenate([self.docs, more])
        return out[code]

    def dictionary(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.groups), 50_000):
            part = self.groups[k : k + 50_000]
            n = len(part)
            columns = {"block": pa.array(np.full(n, self.number)), "code": pa.array(np.arange(k, k + n, dtype=np.int32)), "group": pa.array(part, pa.string()), "freq": pa.array(self.freq[k : k + n]), "docs": pa.array(self.docs[k : k + n])}
            yield _batch(columns, n)

    def full(self) -> bool:
        return self.used >= self.limits[0] or len(self.groups) >= self.limits[1]


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _ENCODED], schema=_ENCODED)


def _chunk_rows(chunk: T.Chunk, ids: pa.Array, tok_a: ByteLevel, tok_b: Pieces, block: Block) -> pa.RecordBatch:
    """The documents of a chunk of spaced texts (a text without characters has none)."""
    rows = chunk.rows
    texts = [chunk.cps[x:y].tobytes().decode("utf-32-le") for x, y in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True)]
    raw, bounds = T.utf8(pa.array(texts, pa.large_string()))
    done = tok_a.encode(chunk)
    flat_b, bounds_b = tok_b.encode([x[1:] for x in texts])
    end_a = np.concatenate([[0], np.cumsum(tok_a.bytes.size[done.ids])])
    end_b = np.concatenate([[0], np.cumsum(tok_b.bytes.size[flat_b])])
    good = (np.diff(bounds) > 1) & _rows_equal(tok_a.bytes.joined(done.ids), end_a[done.bounds], raw, bounds)
    good &= _rows_equal(tok_b.bytes.joined(flat_b), end_b[bounds_b], raw, bounds)
    some = np.flatnonzero(good)
    a, n_a = _picked(done.ids, done.bounds, some)
    b, n_b = _picked(flat_b, bounds_b, some)
    # both cover the same bytes, text after text: offsets over the whole chunk
    end_a, end_b = np.cumsum(tok_a.bytes.size[a]), np.cumsum(tok_b.bytes.size[b])
    _, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    a_start, b_start = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
    if not len(last_a):
        a_start, b_start = a_start[:0], b_start[:0]
    codes = block.codes(a, b, a_start, last_a + 1 - a_start, b_start, last_b + 1 - b_start)
    block.used += len(codes)
    cuts = np.searchsorted(last_a, np.concatenate([[0], np.cumsum(n_a)]), "left")
    names = np.array(block.groups, object)
    out = {c: np.zeros(rows, np.int64) for c in ("n_a", "n_b", "n_groups")}
    digests, own, times = [""] * rows, [b""] * rows, [b""] * rows
    for k, (row, x, y) in enumerate(zip(some.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        part = codes[x:y]
        out["n_a"][row], out["n_b"][row], out["n_groups"][row] = n_a[k], n_b[k], y - x
        digests[row] = hashlib.sha256(";".join(names[part].tolist()).encode()).hexdigest()
        distinct, count = np.unique(part, return_counts=True)
        block.freq[distinct] += count
        block.docs[distinct] += 1
        own[row], times[row] = distinct.astype("<i4").tobytes(), count.astype("<i4").tobytes()
    columns = {c: pa.array(v) for c, v in out.items()}
    columns |= {"block": pa.array(np.full(rows, block.number)), "doc_id": ids, "groups_sha256": pa.array(digests, pa.string()), "codes": pa.array(own, pa.binary()), "times": pa.array(times, pa.binary())}
    return _batch(columns, rows)


def encode(docs: DataFrame, *, a: str | None = None, b: str | None = None, block_codes: int = BLOCK_CODES, block_groups: int = BLOCK_GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ENCODED_SCHEMA: documents (`code` null) and the entries of blocks' dictionaries (`code` given)."""
    path_a, path_b = a or K.tokenizer_path(), b or K.tokenizer_path(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok_a, tok_b = tokenizers(path_a, path_b)
        block = Block(TaskContext.get().partitionId() << 24, (block_codes, block_groups))
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            for chunk in T.chunks(pc.binary_join_element_wise(_SPACE, texts, _NOTHING)):
                yield _chunk_rows(chunk, batch.column(0).slice(chunk.first, chunk.rows), tok_a, tok_b, block)
                if block.full():
                    yield from block.dictionary()
                    block = Block(block.number + 1, block.limits)
        yield from block.dictionary()

    plain = docs.select(F.col(id_col).try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(scratch.lean(run, "alignment"), ENCODED_SCHEMA)


def links(dictionary: DataFrame, *, weight: str = "freq") -> DataFrame:
    """Distinct groups with their link, weighted by frequency or by documents (`weight`): group, a, b, weight.

    All bytes of a token lie before its end and none is empty, so the tokens that end together in a group are its last ones.
    """
    groups = dictionary.groupBy("group").agg(F.sum(weight).alias("weight"))
    last = lambda side: F.substring_index(side, ",", -1).cast("int")
    return groups.select("group", last(F.substring_index("group", "|", 1)).alias("a"), last(F.substring_index("group", "|", -1)).alias("b"), "weight")


def pair_counts(linked: DataFrame) -> DataFrame:
    """Pairs a, b with their corpus-wide count and whether it is the highest of b; a vocabulary bounds the rows of a window."""
    pairs = linked.groupBy("a", "b").agg(F.sum("weight").alias("count"))
    return pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


_SUMS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _summed(docs: pa.Table, entries: pa.Table) -> pa.Table:
    """Documents of a block with the sums over their links."""
    size = 1 + max(entries.column("code").to_pylist(), default=-1)
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = entries.column("code").to_numpy()
    count[at], best[at] = entries.column("count").to_numpy(), entries.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for codes, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist(), strict=True):
        own, n = np.frombuffer(codes, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
        n_best.append(int((best[own] * n).sum()))
        count_sum.append(int((count[own] * n).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups"])
    return kept.append_column("n_links", docs.column("n_groups")).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))


def align(docs: DataFrame, *, weight: str = "freq", **options) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; options are those of `encode`."""
    stored = scratch.materialise(encode(docs, **options), "alignment")
    dictionary = stored.filter(F.col("code").isNotNull()).select("block", "code", "group", "freq", "docs")
    linked = links(dictionary, weight=weight)
    found = linked.join(pair_counts(linked), ["a", "b"]).select("group", "count", "best")
    entries = dictionary.select("block", "code", "group").join(found, "group").select(F.col("block").alias("of"), "code", "count", "best")
    rows = stored.filter(F.col("code").isNull()).select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times")
    return rows.groupBy("block").cogroup(entries.groupBy("of")).applyInArrow(_summed, _SUMS)
