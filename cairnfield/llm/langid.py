"""Language identification by prediction by partial matching.

For each language a context tree of up to three bytes gives the next byte's
probability; a byte unseen in a context escapes to the next shorter one (method
C: a context with n occurrences of q distinct bytes escapes with q / (n + q)), and
at last to all 256 alike. All bytes are symbols of their own. Statistics are frozen
after learning, so the exact code length of every byte in every context that some
language knows is laid out once, in sorted tables that hold only contexts seen; a
text's code length is a sum of lookups, and the shortest code wins.

The score is the share of the best language among all, by code lengths; as bytes
aren't independent, those of a text longer than EVIDENCE_BYTES count as if it had
that many bytes.

Learning reads a bounded sample: about `sample_rows` documents per language,
chosen by a hash of their ids, which plays no part in predictions. More than
MAX_LANGUAGES languages are refused.

Defined results: `und` with score 0 if the text is null or has no letter, or if
nothing was learned; equal texts get equal results; ties go to the first language
in order of name; a text starts as if after spaces; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as T

ORDER = 3
SAMPLE_ROWS = 1500
MAX_LANGUAGES = 1000
UNKNOWN = "und"
EVIDENCE_BYTES = 200
CHUNK_BYTES, CHUNK_COSTS = 500_000, 4_000_000


class Model(NamedTuple):
    """Counts of (three bytes before, byte) by language, from which every worker lays out its tables."""

    name: str
    languages: list[str]
    keys: list[np.ndarray]
    counts: list[np.ndarray]


class Order(NamedTuple):
    """Code lengths (rows) of (context, byte) keys and of escapes from contexts, by language (columns); keys ascend."""

    keys: np.ndarray
    costs: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def _sequence(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (three bytes before, byte) for all bytes, and their rows; a text starts after spaces."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    padded = np.full(len(raw) + ORDER * n, 32, np.uint32)
    owner = np.repeat(np.arange(1, n + 1, dtype=np.int64), sizes)
    at = np.arange(len(raw), dtype=np.int64) + owner * ORDER
    padded[at] = raw
    keys = padded.copy()
    for k in range(1, ORDER + 1):
        keys[ORDER:] |= padded[ORDER - k : len(padded) - k] << np.uint32(8 * k)
    return keys[at], owner - 1


def tables(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[Order]:
    """Code lengths in bits under each language's frozen counts, from order 0 up; a key's shorter one is in the order below."""
    out: list[Order] = []
    for order in range(ORDER + 1):
        mask = np.uint32((1 << 8 * (order + 1)) - 1)
        cut = [k & mask for k in keys]
        every = np.unique(np.concatenate([*cut, np.zeros(0, np.uint32)]))
        context = every >> np.uint32(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(every) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(every))))
        costs, escapes = np.zeros((len(every), len(keys)), np.float32), np.zeros((len(first), len(keys)), np.float32)
        for k, (c, n) in enumerate(zip(cut, counts, strict=True)):
            seen = np.bincount(np.searchsorted(every, c), weights=n, minlength=len(every))
            total, kinds = (np.bincount(group, weights=x, minlength=len(first)) for x in (seen, seen > 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
                own = np.log2((total + kinds)[group]) - np.log2(seen)
            below = out[-1].costs[np.searchsorted(out[-1].keys, every & (mask >> np.uint32(8))), k] if out else 8.0
            costs[:, k] = np.where(seen > 0, own, escape[group] + below)
            escapes[:, k] = escape
        out.append(Order(every, costs, context[first], escapes))
    return out


def _place(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Numbers of the wanted keys, or -1."""
    at = np.minimum(np.searchsorted(sorted_keys, wanted), max(0, len(sorted_keys) - 1))
    return np.where(sorted_keys[at] == wanted, at, -1) if len(sorted_keys) else np.full(len(wanted), -1)


def costs(keys: np.ndarray, orders: list[Order]) -> np.ndarray:
    """Bits of each byte (rows) under each language (columns); a context that no language knows is passed over."""
    at = _place(orders[ORDER].keys, keys)
    out = orders[ORDER].costs[at]
    new = np.flatnonzero(at < 0)
    out[new] = 0
    for order in range(ORDER, -1, -1):
        if order < ORDER:
            at = _place(orders[order].keys, keys[new] & np.uint32((1 << 8 * (order + 1)) - 1))
            out[new[at >= 0]] += orders[order].costs[at[at >= 0]]
            new = new[at < 0]
        context = _place(orders[order].contexts, (keys[new] & np.uint32((1 << 8 * (order + 1)) - 1)) >> np.uint32(8))
        out[new[context >= 0]] += orders[order].escapes[context[context >= 0]]
    out[new] += 8
    return out


_tables: dict[str, list[Order]] = {}
scratch.CACHES["langid"] = _tables


def code_lengths(raw: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """Bits of each text (rows) under each language (columns)."""
    if model.name not in _tables:
        _tables.clear()
        _tables[model.name] = tables(model.keys, model.counts)
    out = np.zeros((len(bounds) - 1, len(model.languages)))
    keys, owner = _sequence(raw, bounds)
    step = max(1, CHUNK_COSTS // max(1, len(model.languages)))
    for k in range(0, len(keys), step):
        part, own = costs(keys[k : k + step], _tables[model.name]), owner[k : k + step]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[first]] += np.add.reduceat(part, first, axis=0, dtype=np.float64)
    return out


def _byte_pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw, bounds = T.utf8(column)
    first = 0
    while first < len(bounds) - 1:
        last = min(max(int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, "right")) - 1, first + 1), len(bounds) - 1)
        yield first, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows of `docs` with a language."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.pmod(F.xxhash64(F.col(id_col), text, F.lit(5)), F.lit(1 << 31))
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), place.alias("h"))
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(total) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages, name = sorted(total), uuid.uuid4().hex
    if not languages:
        return Model(name, [], [], [])
    share = docs.sparkSession.createDataFrame([(k, int(min(1.0, sample_rows / total[k]) * 2**31)) for k in languages], "lang string, below bigint")
    sample = rows.join(F.broadcast(share), "lang").filter("h < below").select("lang", "text")  # at most MAX_LANGUAGES short rows are broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, raw, bounds in _byte_pieces(batch.column(1)):
                keys, owner = _sequence(raw, bounds)
                by = langs[first : first + len(bounds) - 1]
                for lang in set(by.tolist()):
                    new, n = np.unique(keys[(by == lang)[owner]], return_counts=True)
                    if lang in held:
                        old, m = held[lang]
                        every, back = np.unique(np.concatenate([old, new]), return_inverse=True)
                        new, n = every, np.bincount(back, weights=np.concatenate([m, n])).astype(np.int64)
                    held[lang] = new, n
        for lang, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "k", "n"])

    found = sample.mapInArrow(scratch.lean(count, "langid"), "lang string, k bigint, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    lang, key, n = np.array(found.column(0).to_pylist(), object), found.column(1).to_numpy(), found.column(2).to_numpy()
    keys, counts = [], []
    for one in languages:
        mine = np.flatnonzero(lang == one)
        mine = mine[np.argsort(key[mine])]
        keys.append(key[mine].astype(np.uint32))
        counts.append(n[mine].astype(np.int64))
    return Model(name, languages, keys, counts)


def predict(docs: DataFrame, model: Model, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred and score."""
    keep = keep or ["doc_id"]
    shared: Any = docs.sparkSession.sparkContext.broadcast(model)  # the counts of a bounded sample
    plain = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            column = batch.column(len(keep))
            best = np.full(batch.num_rows, len(own.languages))
            score = np.zeros(batch.num_rows)
            if own.languages:
                for first, raw, bounds in _byte_pieces(column):
                    bits = code_lengths(raw, bounds, own)
                    sizes = np.maximum(np.diff(bounds), 1)
                    least = bits.argmin(axis=1)
                    gap = (bits - bits.min(axis=1, keepdims=True)) * np.log(2) * np.minimum(1.0, EVIDENCE_BYTES / sizes)[:, None]
                    best[first : first + len(sizes)] = least
                    score[first : first + len(sizes)] = 1 / np.exp(-gap).sum(axis=1)
                for chunk in T.chunks(column):
                    letters = np.concatenate([[0], np.cumsum(T.class_table()[chunk.cps] == T.LETTER)])
                    none = chunk.first + np.flatnonzero(np.diff(letters[chunk.bounds]) == 0)
                    best[none], score[none] = len(own.languages), 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return plain.mapInArrow(scratch.lean(run, "langid"), f"{kept_fields}, lang_pred string, score double")
