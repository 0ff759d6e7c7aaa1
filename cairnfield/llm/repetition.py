"""Quality rules by repetition coverage: characters inside of duplicated n-grams and lines.

Whole texts are cut into words (runs without ASCII white space) on arrays of code
points. Hashes of n words roll from length to length, h(n) = mix(h(n - 1) * m +
next word), so each of the lengths costs one pass; windows that occur before in
the same text are marked, and the characters of words that marked windows cover
are counted once. Lines are compared by their hashes in the same way.

A text passes the base rules if it has at least MIN_WORDS words and at most half
of them stand in windows of three words found twice or more. It is kept if also
no share of characters, in lines that repeat an earlier one or in windows of 5 to
10 words that repeat an earlier one, exceeds its limit. Texts are judged one by
one, without a shuffle. Hashes have 64 bits: two different windows of one text of
a million words are taken for equal with a probability below 3e-8.

Defined results: a null or empty text, or one of white space alone, has no words,
fails the base rules and is dropped; repeated rows are judged each for itself;
ids that are no whole numbers are null; an empty table gives an empty table;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as T

MIN_WORDS, MAX_REPEAT_PERCENT, BASE_WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
#: Greatest shares of the characters in words: in repeated lines, and in repeated windows of so many words.
MAX_LINE_SHARE = 0.20
MAX_GRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, dup_line_share double, dup_gram_shares array<double>"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LINE_FEED, _KINDS = 10, 128


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point below 128: white space, symbols."""
    space, symbol = np.zeros(_KINDS, bool), np.zeros(_KINDS, bool)
    space[[32, *range(9, 14)]] = True
    symbol[[ord(x) for x in SYMBOLS]] = True
    return space, symbol


def _by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (row, hash): whether it occurs twice or more, and whether it occurred before."""
    codes, _ = pd.factorize(T.mix64(hashes + T.mix64(row.astype(np.uint64) + np.uint64(1))))
    counts = np.bincount(codes)
    first = np.zeros(len(codes), bool)
    where = np.empty(len(counts), np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    first[where] = True
    return counts[codes] > 1, ~first


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words covered by windows of `width` words at `starts`."""
    step = np.zeros(n + 1, np.int32)
    step[starts] += 1
    step[starts + width] -= 1
    return np.cumsum(step[:-1]) > 0


def measures(chunk: T.Chunk) -> dict[str, np.ndarray]:
    """For each row of a chunk: the counts of SCHEMA, characters in repeated lines, and (a column a length) in repeated windows."""
    space, symbol = _tables()
    cps, bounds, rows = chunk.cps, chunk.bounds, chunk.rows
    low = np.minimum(cps, _KINDS - 1)
    inside = ~space[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(cps))]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size, words = ends - starts, np.searchsorted(starts, bounds)
    n_words = np.diff(words)

    # lines: from a row's start or a line feed to the next one
    feeds = np.flatnonzero(cps == _LINE_FEED)
    line, stops = np.sort(np.concatenate([bounds[:-1], feeds + 1])), np.sort(np.concatenate([bounds[1:], feeds]))
    chars = np.concatenate([[0], np.cumsum(inside)])
    line_chars = chars[stops] - chars[line]
    row = np.repeat(np.arange(rows), 1 + _by_row(cps == _LINE_FEED, bounds))
    some = np.flatnonzero(line_chars > 0)
    dup_line = np.zeros(len(line), bool)
    if len(some):
        dup_line[some] = _repeats(T.run_hashes(cps, line[some], stops[some] - line[some]), row[some])[1]

    out = {
        "n_words": n_words,
        "word_chars": _by_row(inside, bounds),
        "n_symbols": _by_row(symbol[low], bounds),
        "n_dup_lines": np.bincount(row, weights=dup_line, minlength=rows).astype(np.int64),
        "dup_line_chars": np.bincount(row, weights=dup_line * line_chars, minlength=rows).astype(np.int64),
        "n_repeat_words": np.zeros(rows, np.int64),
        "dup_gram_chars": np.zeros((rows, len(MAX_GRAM_SHARE)), np.int64),
    }
    if not len(starts):
        return out
    own = T.run_hashes(cps, starts, size)
    word_row, at = np.repeat(np.arange(rows), n_words), np.arange(len(starts))
    left = np.repeat(words[1:], n_words) - at  # words from here to the row's end
    rolled = own
    for width in range(2, max(MAX_GRAM_SHARE) + 1):
        whole = left >= width
        at, rolled, left = at[whole], rolled[whole], left[whole]
        if not len(at):
            break
        rolled = T.mix64(rolled * _MULTIPLIER + own[at + width - 1])
        if width != BASE_WINDOW and width not in MAX_GRAM_SHARE:
            continue
        twice, later = _repeats(rolled, word_row[at])
        if width == BASE_WINDOW:
            out["n_repeat_words"] = _by_row(_covered(at[twice], width, len(starts)), words)
        if width in MAX_GRAM_SHARE:
            out["dup_gram_chars"][:, list(MAX_GRAM_SHARE).index(width)] = _by_row(np.where(_covered(at[later], width, len(starts)), size, 0), words)
    return out


def verdicts(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """base_failed, kept and the shares behind it."""
    most = np.maximum(m["word_chars"], 1)
    line, gram = m["dup_line_chars"] / most, m["dup_gram_chars"] / most[:, None]
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    kept = ~failed & (line <= MAX_LINE_SHARE) & (gram <= np.array(list(MAX_GRAM_SHARE.values()))).all(axis=1)
    return {"base_failed": failed, "kept": kept, "dup_line_share": line, "dup_gram_shares": gram}


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of SCHEMA for each document."""
    scratch.small_batches(docs.sparkSession)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                m = measures(chunk)
                m |= verdicts(m)
                grams = m["dup_gram_shares"]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(chunk.rows + 1, dtype=np.int32) * grams.shape[1]), pa.array(grams.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), *(pa.array(m[c]) for c in columns), lists], names=["doc_id", *columns, "dup_gram_shares"])

    return docs.select(F.col(id_col).try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scratch.lean(run), SCHEMA)
