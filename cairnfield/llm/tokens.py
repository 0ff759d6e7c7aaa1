"""Byte-level BPE ids of whole texts at the speed of a cache of distinct pre-tokens.

The `tokenizers` library encodes each distinct pre-token once per worker; texts
are cut into pre-tokens on arrays (the split of byte-level BPE: contractions,
letters, numbers, others, each with one leading space, and white space), and the
ids are gathered from the cache. Texts that hold an added token of the tokenizer
(such as `<|endoftext|>`) are encoded whole by the library instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa

from . import scratch
from . import text as T

CACHE_PRETOKENS = 2_000_000
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoded(NamedTuple):
    """Ids of consecutive rows: row `first + i` has `ids[bounds[i]:bounds[i + 1]]`."""

    first: int
    ids: np.ndarray
    bounds: np.ndarray


def pretoken_starts(chunk: T.Chunk) -> np.ndarray:
    """Starts of the pre-tokens of a chunk, each ending where the next one starts."""
    cps, bounds = chunk.cps, chunk.bounds
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = T.class_table()[cps]
    row_start = np.zeros(n + 1, bool)
    row_start[bounds] = True
    space = kind == T.SPACE
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= row_start[:-1]
    # the last space of a run that text follows stands alone or leads the text
    last_space = np.zeros(n, bool)
    last_space[:-1] = space[:-1] & ~space[1:]
    last_space &= ~row_start[1:]
    start |= last_space
    leads = last_space & (cps == 32)
    led = np.zeros(n, bool)
    led[1:] = leads[:-1]
    start &= ~led
    # contractions: an apostrophe that begins a pre-token, followed by one of a few letters
    quote = np.flatnonzero((cps == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~row_start[quote + 1] & (kind[quote + 1] == T.LETTER)]
    if len(quote):
        a = cps[quote + 1]
        inside = quote + 2 < n
        b = np.where(inside & ~row_start[np.minimum(quote + 2, n)], cps[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        after = after[after < n]
        start[after[kind[after] == T.LETTER]] = True
    return np.flatnonzero(start)


class Slots:
    """Numbers of 64-bit keys in open addressing, looked up and added by arrays: about 24 bytes a key."""

    def __init__(self, bits: int = 17) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.slots = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out, at, todo, last = np.full(len(keys), -1, np.int64), self._home(keys), np.arange(len(keys)), len(self.slots) - 1
        while len(todo):
            place = at[todo]
            slot = self.slots[place]
            hit = (slot >= 0) & (self.keys[place] == keys[todo])
            out[todo[hit]] = slot[hit]
            todo = todo[(slot >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & last
        return out

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet."""
        if 2 * (self.n + len(keys)) > len(self.slots):
            held = self.slots >= 0
            old_keys, old_slots = self.keys[held], self.slots[held]
            self.__init__(max(self.bits + 1, int(2 * (self.n + len(keys))).bit_length() + 1))
            self.add(old_keys, old_slots)
        self.n += len(keys)
        at, todo, last = self._home(keys), np.arange(len(keys)), len(self.slots) - 1
        while len(todo):
            place = at[todo]
            free = self.slots[place] < 0
            some, spot = todo[free], place[free]
            self.slots[spot] = slots[some]  # of several for one place one stays
            won = self.slots[spot] == slots[some]
            self.keys[spot[won]] = keys[some[won]]
            todo = np.concatenate([todo[~free], some[~won]])
            at[todo] = (at[todo] + 1) & last


class Encoder:
    """Encodes columns of texts; the cache is emptied when it holds more than CACHE_PRETOKENS."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [np.array(list(map(ord, x.content)), np.uint32) for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self._clear()

    def _clear(self) -> None:
        self.known = Slots()
        self.ids = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.n = 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.asarray(found.ids, self.ids.dtype)
        counts = np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(pieces)) if len(ids) else np.zeros(len(pieces), np.int64)
        used = int(self.bounds[self.n])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(keys) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[used : used + len(ids)] = ids
        self.bounds[self.n + 1 : self.n + len(keys) + 1] = used + np.cumsum(counts)
        self.known.add(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _rows_with_added(self, chunk: T.Chunk) -> np.ndarray:
        """Numbers of the rows that hold an added token."""
        rows = [np.zeros(0, np.int64)]
        for token in self.added:
            at = np.flatnonzero(chunk.cps[: max(0, len(chunk.cps) - len(token) + 1)] == token[0])
            for k in range(1, len(token)):
                at = at[chunk.cps[at + k] == token[k]]
            row = np.searchsorted(chunk.bounds, at, "right") - 1
            rows.append(row[at + len(token) <= chunk.bounds[row + 1]])
        return np.unique(np.concatenate(rows))

    def encode_chunk(self, chunk: T.Chunk) -> Encoded:
        done = self.encode_pretokens(chunk)
        rows = self._rows_with_added(chunk)
        if not len(rows):
            return done
        counts, parts, last = np.diff(done.bounds), [], 0
        for row in rows.tolist():
            text = chunk.cps[chunk.bounds[row] : chunk.bounds[row + 1]].tobytes().decode("utf-32-le")
            own = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, done.ids.dtype)
            parts += [done.ids[done.bounds[last] : done.bounds[row]], own]
            counts[row], last = len(own), row + 1
        parts.append(done.ids[done.bounds[last] :])
        return Encoded(chunk.first, np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)]))

    def encode_pretokens(self, chunk: T.Chunk) -> Encoded:
        """Ids of a chunk's rows; the strings of added tokens are plain text."""
        starts = pretoken_starts(chunk)
        if not len(starts):
            return Encoded(chunk.first, np.zeros(0, self.ids.dtype), np.zeros(chunk.rows + 1, np.int64))
        if self.n > CACHE_PRETOKENS:
            self._clear()
        lengths = np.diff(np.append(starts, len(chunk.cps)))
        codes, distinct = pd.factorize(T.run_hashes(chunk.cps, starts, lengths))
        slots = self.known.find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            where = np.empty(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = where[new]
            data = chunk.cps.tobytes()
            pieces = [data[4 * s : 4 * (s + n)].decode("utf-32-le") for s, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
            slots[new] = np.arange(self.n, self.n + len(new))
            self._learn(distinct[new], pieces)
        slot = slots[codes]
        first, count = self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot]
        ids = self.ids[T.ranges(first, count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return Encoded(chunk.first, ids, total[np.searchsorted(starts, chunk.bounds)])

    def encode(self, column: pa.Array) -> Iterator[Encoded]:
        for chunk in T.chunks(column):
            yield self.encode_chunk(chunk)


_encoders: dict[str, Encoder] = {}
scratch.CACHES["tokens"] = _encoders


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
