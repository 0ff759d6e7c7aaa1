"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as `<|im_start|>role<|im_sep|>text<|im_end|>` lines,
encoded once with character offsets, and the sorted spans of its assistant texts
are intersected with the sorted token spans by binary search. The three marks are
single added tokens, so no token crosses from a mark into a text. Inside roles
and texts a backslash is put between `<` and `|` (one more, where some stand
there), which leaves no control string and is undone on reading.

The turns of a conversation stand in one task, as a digest of them is made in order;
a very long one passes through it in parts, so memory is bounded.

Defined results: null roles and texts are empty; turns are ordered by turn, role
and text, so repeated rows all stay; rows with a null id, or one that is
no whole number, are one conversation; a
conversation without assistant rows has an empty mask; very long conversations are
encoded in parts of about PART_CHARS that end with a turn, which gives the same ids;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as T
from . import tokens as K

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLES = ("assistant",)
PART_CHARS, BATCH_CHARS = 2_000_000, 1_000_000
SCHEMA = "conv_id bigint, part int, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>, turn_starts array<int>, turn_ends array<int>"
_ints = pa.list_(pa.int32())
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("ids", _ints), ("token_starts", _ints), ("token_ends", _ints), ("loss_mask", pa.list_(pa.bool_())), ("turn_starts", _ints), ("turn_ends", _ints)])
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED_ROLES) -> tuple[str, list[int], list[int]]:
    """The formatted text, and starts and ends of the texts to train on."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        if role in trained:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), starts, ends


def loss_mask(token_starts: np.ndarray, token_ends: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """True for tokens that share a character with one of the spans, which are sorted and don't overlap."""
    first = np.searchsorted(token_ends, starts, "right")
    last = np.searchsorted(token_starts, ends, "left")
    step = np.zeros(len(token_starts) + 1, np.int64)
    some = np.asarray(starts) < np.asarray(ends)
    np.add.at(step, first[some], 1)
    np.add.at(step, last[some], -1)
    return np.cumsum(step)[:-1] > 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mark_ids(path: str) -> tuple[list[int], np.ndarray]:
    """Ids of the three marks, which follow the vocabulary's, and the bytes of each token of byte-level BPE."""
    if path not in _marks:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        size = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        for token, k in vocabulary.items():
            size[k] = len(token)  # each character of a token's name stands for a byte
        _marks[path] = [len(size) + k for k in range(3)], size
    return _marks[path]


_marks: dict[str, tuple[list[int], np.ndarray]] = {}
scratch.CACHES["chat"] = _marks


def encode(turns: list[tuple[str, str]], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of rendered turns, starts and ends of their tokens in code points, and the number of tokens of each turn.

    Roles and texts hold no control string, so the pieces between marks are encoded each
    for itself, by the cache of pre-tokens that all texts share, and joined with the marks.
    """
    marks, size = mark_ids(path)
    column = pa.array([x for role, text in turns for x in (escape(role), escape(text), "\n")], pa.large_string())
    parts = list(K.encoder(path).encode(column))
    ids = np.concatenate([x.ids for x in parts]).astype(np.int64)
    counts = np.concatenate([np.diff(x.bounds) for x in parts])
    raw, bounds = T.utf8(column)
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points that begin before a byte
    last = np.cumsum(size[ids])
    starts, ends = begun[last - size[ids] + 1] - 1, begun[last]
    # six units a turn: mark, role, mark, text, mark, end of line
    width = np.empty((len(turns), 6), np.int64)
    width[:, 0::2] = [len(x) for x in (START, SEPARATOR, END)]
    width[:, 1::2] = np.diff(begun[bounds]).reshape(-1, 3)
    tokens = np.ones((len(turns), 6), np.int64)
    tokens[:, 1::2] = counts.reshape(-1, 3)
    at = np.concatenate([[0], np.cumsum(width.reshape(-1))])[:-1].reshape(-1, 6)
    place = np.concatenate([[0], np.cumsum(tokens.reshape(-1))])
    first = place[:-1].reshape(-1, 6)
    out = [np.empty(place[-1], np.int64) for _ in range(3)]
    own = T.ranges(first[:, 1::2].reshape(-1), counts)
    shift = np.repeat((at[:, 1::2] - begun[bounds[:-1]].reshape(-1, 3)).reshape(-1), counts)
    out[0][own], out[1][own], out[2][own] = ids, starts + shift, ends + shift
    for k, mark in enumerate(marks):
        spot = first[:, 2 * k]
        out[0][spot], out[1][spot], out[2][spot] = mark, at[:, 2 * k], at[:, 2 * k] + width[:, 2 * k]
    return out[0], out[1], out[2], tokens.sum(axis=1)


def _sorted_turns(rows: DataFrame) -> DataFrame:
    n = scratch.partitions(rows.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(rows: DataFrame, *, tokenizer: str | None = None, trained: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """One row (SCHEMA) for each conversation: formatted text, ids, character offsets and loss mask of its tokens."""
    path = tokenizer or K.tokenizer_path()

    def made(groups: list[tuple[int, int, list[tuple[str, str]]]]) -> pa.RecordBatch:
        """All conversations of a batch at once: one call each of the encoder and of the binary search."""
        ids, starts, ends, counts = encode([x for *_, turns in groups for x in turns], path)
        rendered = [render(turns, trained) for *_, turns in groups]
        size = np.array([len(text) for text, *_ in rendered])
        base = np.cumsum(size) - size
        spans = [np.concatenate([np.array(x[k], np.int64) + b for x, b in zip(rendered, base.tolist(), strict=True)]) for k in (1, 2)]
        mask = loss_mask(starts, ends, *spans)
        turns = np.cumsum([0] + [len(x) for *_, x in groups])
        bounds = np.concatenate([[0], np.cumsum(counts)])[turns]
        back = np.repeat(base, np.diff(bounds))
        tokens = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), x) for x in (*(pa.array(v.astype(np.int32)) for v in (ids, starts - back, ends - back)), pa.array(mask))]
        spans_ = [pa.array([x[k] for x in rendered], _ints) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in groups], pa.int64()), pa.array([x[1] for x in groups], pa.int32()), pa.array([x[0] for x in rendered], pa.string()), *tokens, *spans_], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)

        out: list[tuple[int, int, list[tuple[str, str]]]] = []
        size = 0
        for conv_id, group in groupby(turns(), key=lambda x: x[0]):
            part, held, chars = 0, [], 0
            for _, role, text in group:
                held.append((role, text))
                chars += len(text) + len(role)
                if chars >= PART_CHARS:
                    yield made([*out, (conv_id, part, held)])
                    out, size = [], 0
                    part, held, chars = part + 1, [], 0
            if held:
                out.append((conv_id, part, held))
                size += chars
            if size >= BATCH_CHARS or len(out) >= 2_000:
                yield made(out)
                out, size = [], 0
        if out:
            yield made(out)

    empty = F.lit("")
    plain = rows.select(F.col("conv_id").try_cast("bigint").alias("conv_id"), F.col("turn").try_cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    return _sorted_turns(plain).mapInArrow(scratch.lean(run, "tokens"), SCHEMA)


def read_back(formatted: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Digests of turns and of the text under the loss mask, from formatted text, offsets and mask alone.

    Rows are brought together by conversation and part; `ordered` says that they still stand as `format_conversations` made them.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
    arrow = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in schema.split(", ")])

    def under_mask(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[str]:
        edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            yield unescape(text[starts[a] : ends[b - 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                lists = [batch.column(c) for c in (3, 4, 5)]
                bounds = lists[0].offsets.to_pylist()
                flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
                rows = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
                for row, a, b in zip(rows, bounds[:-1], bounds[1:], strict=True):
                    yield *row, *(x[a:b] for x in flat)

        out: list[tuple] = []
        for conv_id, group in groupby(parts(), key=lambda x: x[0]):
            said, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = n_tokens = loss_tokens = 0
            for _, _, text, starts, ends, mask in group:
                for role, body in parse(text):
                    said.update(f"{role}\n{body}\n".encode("utf-8", "replace"))
                    n_turns += 1
                for piece in under_mask(text, starts, ends, mask):
                    loss.update(piece.encode("utf-8", "replace"))
                    loss_chars += len(piece)
                chars += len(text)
                n_tokens += len(mask)
                loss_tokens += int(mask.sum())
            out.append((conv_id, n_turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars, n_tokens, loss_tokens))
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    rows = formatted.select("conv_id", "part", "formatted", "token_starts", "token_ends", "loss_mask")
    if not ordered:
        rows = rows.repartition(scratch.partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(scratch.lean(run, "tokens"), schema)
