"""Vectorised text kernels on whole Arrow batches.

A batch of texts is decoded once into an array of code points; characters are
classified through lookup tables and runs (words, pre-tokens) are hashed with
`np.add.reduceat`, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

N_CODE_POINTS = 0x110000
OTHER, LETTER, NUMBER, SPACE, END = range(5)
CHUNK_CHARS = 1_000_000

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Chunk(NamedTuple):
    """Consecutive rows of a batch: `cps[bounds[i]:bounds[i + 1]]` is the text of row `first + i`."""

    first: int
    rows: int
    cps: np.ndarray
    bounds: np.ndarray


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _all_chars() -> str:
    return "".join(map(chr, (*range(0xD800), *range(0xE000, N_CODE_POINTS))))


@cache
def class_table() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE for each code point, by Unicode property."""
    import regex

    table = np.zeros(N_CODE_POINTS, np.uint8)
    text = _all_chars()
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, text):
            first, last = ord(found[0][0]), ord(found[0][-1])
            table[first : last + 1] = kind
    return table


@cache
def word_table() -> np.ndarray:
    """True where a code point belongs to a word (letters, marks, digits, underscore)."""
    import regex

    table = np.zeros(N_CODE_POINTS, bool)
    for found in regex.finditer(r"[\w\p{M}]+", _all_chars()):
        table[ord(found[0][0]) : ord(found[0][-1]) + 1] = True
    return table


@cache
def lower_table() -> np.ndarray:
    """The (first) lower-case code point of each code point."""
    table = np.arange(N_CODE_POINTS, dtype=np.uint32)
    for i in (*range(0xD800), *range(0xE000, 0x1F000)):
        low = chr(i).lower()
        table[i] = ord(low[0])
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[Chunk]:
    """Code points of a string column, in pieces of whole rows of about `limit` bytes."""
    n = len(column)
    if not n:
        return
    raw, bounds = utf8(column)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        part = raw[bounds[first] : bounds[last]]
        cps = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        starts = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=starts[1:])
        yield Chunk(first, last - first, cps, starts[bounds[first : last + 1] - bounds[first]])
        first = last


_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(size: int, base: int) -> np.ndarray:
    """base ** i modulo 2**64; tables for texts of unusual length are made anew."""
    return _short_powers(size, base) if size <= 1 << 21 else _short_powers.__wrapped__(size, base)


@cache
def _short_powers(size: int, base: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        step = min(done, size - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def run_hashes(cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs `cps[starts[i]:starts[i] + lengths[i]]`: polynomials, as differences of one cumulative sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(20, len(cps).bit_length())
    weighted = cps.astype(np.uint64)
    weighted += np.uint64(1)
    weighted *= _powers(size, _MULTIPLIER)[: len(cps)]
    # sums wrap modulo 2**64, and so do their differences; the start's power is divided out
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(weighted, out=total[1:])
    found = (total[starts + lengths] - total[starts]) * _powers(size, _INVERSE)[starts]
    return mix64(found ^ (lengths.astype(np.uint64) << np.uint64(48)))


class Words(NamedTuple):
    """Words of a chunk: hash, code-point start in the chunk, length; bounds by row."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray


def words(chunk: Chunk, *, hashed: bool = True) -> Words:
    """Lower-cased words (runs of letters, marks, digits and underscores) of a chunk's rows."""
    cps, bounds = chunk.cps, chunk.bounds
    inside = word_table()[cps]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = bounds[(bounds > 0) & (bounds < len(cps))]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - starts
    hashes = run_hashes(lower_table()[cps], starts, lengths) if hashed else np.zeros(0, np.uint64)
    return Words(hashes, starts, lengths, np.searchsorted(starts, bounds))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words by row, and their bounds; a row of fewer words has one for all its words."""
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = ranges(bounds[:-1], count)
    size = np.repeat(np.minimum(n, width), count)
    out = np.zeros(len(at), np.uint64)
    limit = max(len(hashes) - 1, 0)
    for k in range(width):
        here = k < size
        value = np.where(here, hashes[np.minimum(at + k, limit)], np.uint64(0)) if len(hashes) else out
        out = mix64(out * np.uint64(_MULTIPLIER) + value)
    return out, np.concatenate([[0], np.cumsum(count)])
