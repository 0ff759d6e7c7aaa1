"""64-bit SimHash over three-token shingles, and similarities of such hashes.

Hashes are signed 64-bit integers with the bits of the unsigned value; `as_hex`
renders them as sixteen digits, or `0` for text without tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of FNV-1a (64 bits).
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
THRESHOLD = 0.9
SHINGLE = 3


def tokens(body: Column) -> Column:
    """Lower-case alphanumeric runs outside of scripts, styles and tags, without nonces (six characters or more with a digit)."""
    return F.filter(F.split(_plain(body), "[^a-z0-9]+"), lambda t: (F.length(t) > 0) & ~((F.length(t) >= 6) & t.rlike("[0-9]")))


def _plain(body: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(body, r"(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>", " "), "<[^>]+>", " "))


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Windows of k tokens; fewer tokens are one shingle, none give none."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(words, " "))).otherwise(windows)


def fnv1a64(s: Column) -> Column:
    """FNV-1a over the low bytes of an ASCII string, in 32-bit halves, so that nothing overflows."""
    low = F.lit(0xFFFFFFFF)
    start = F.named_struct(F.lit("hi"), F.lit(OFFSET >> 32), F.lit("lo"), F.lit(OFFSET & 0xFFFFFFFF))

    def step(state: Column, c: Column) -> Column:
        x = state["lo"].bitwiseXOR(F.ascii(c).cast("bigint"))
        product = x * 435  # the prime is 2**40 + 435
        hi = state["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(x, 8)
        return F.named_struct(F.lit("hi"), hi.bitwiseAND(low), F.lit("lo"), product.bitwiseAND(low))

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda z: F.shiftleft(z["hi"], 32).bitwiseOR(z["lo"]))


def simhash_expr(body: Column) -> Column:
    """SimHash as one expression: exact, but interpreted; for short texts and tests."""
    hashes = F.transform(F.get(F.transform(F.array(tokens(F.coalesce(body, F.lit("")))), lambda w: shingles(w)), F.lit(0)), fnv1a64)
    zero = F.array_repeat(F.lit(0), 64)
    bits = F.sequence(F.lit(0), F.lit(63))
    votes = F.aggregate(hashes, zero, lambda acc, h: F.zip_with(acc, bits, lambda v, b: v + F.when(F.expr("1") == F.call_function("getbit", h, b), 1).otherwise(-1)))
    one = F.aggregate(F.zip_with(votes, bits, lambda v, b: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(hashes) == 0, F.lit(None).cast("bigint")).otherwise(one)


PIECE_BYTES = 4_000_000


def fnv_of(data: list[bytes]) -> np.ndarray:
    """FNV-1a of byte strings side by side, over one flat buffer: at each place only the strings that reach it."""
    size = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    flat, falling = np.frombuffer(b"".join(data), np.uint8), -size[order]
    h = np.full(len(data), OFFSET, np.uint64)
    for j in range(int(size.max(initial=0))):
        n = int(np.searchsorted(falling, -j))
        h[:n] = (h[:n] ^ flat[start[:n] + j]) * np.uint64(PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def _votes(rows: list[list[str]]) -> list[int]:
    """SimHash of each row's shingles, none of which is empty of them."""
    h = fnv_of([x.encode("latin-1") for row in rows for x in row])
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    count = np.array([len(row) for row in rows])
    first = np.cumsum(count) - count
    votes = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > count[:, None]
    return [int.from_bytes(x.tobytes(), "big", signed=True) for x in np.packbits(votes, axis=1)]


_NONCE = re.compile(r"[0-9]")


def _shingles_of(plain: str) -> list[str]:
    """The shingles of a lower-case text without markup, as `shingles` of `tokens`."""
    words = [w for w in re.split("[^a-z0-9]+", plain) if w and not (len(w) >= 6 and _NONCE.search(w))]
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, min(len(words), 1)))]


@F.pandas_udf(LongType())
def _simhash_of_plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        # copies, as of a page that a host answers everything with, are read once
        out: dict[str | None, int | None] = dict.fromkeys(batch)
        held: list[tuple[str, list[str]]] = []
        size = 0
        for k, x in enumerate(out):
            if x and (own := _shingles_of(x)):
                held.append((x, own))
                size += sum(map(len, own)) + 8 * len(own)
            if held and (size >= PIECE_BYTES or k == len(out) - 1):
                out |= zip([x for x, _ in held], _votes([row for _, row in held]), strict=True)
                held, size = [], 0
        yield pd.Series([out[x] for x in batch], dtype="Int64")


def simhash(body: Column) -> Column:
    """SimHash with markup removed in the JVM and tokens, shingles and votes on batches; null without tokens."""
    return _simhash_of_plain(_plain(F.coalesce(body, F.lit(""))))


def as_hex(h: Column) -> Column:
    return F.coalesce(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("0"))


def hamming(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.bit_count(F.coalesce(a, zero).bitwiseXOR(F.coalesce(b, zero)))


def similarity(a: Column, b: Column) -> Column:
    """One less the share of different bits; two empty texts are alike."""
    return F.lit(1.0) - hamming(a, b) / F.lit(64.0)
