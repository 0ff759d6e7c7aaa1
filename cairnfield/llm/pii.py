"""Personal data: base patterns, and terms that disclose a protected entity by corpus co-occurrence.

Protected entities are the values that the base patterns find. A term of a document
that holds entity e discloses it by the share d = PMI(e; t) / IC(e), where
PMI = ln(n_et N / (n_e n_t)) and IC = ln(N / n_e) over document counts of the
whole corpus: 1 if the term occurs with e only, 0 if it is independent of it.
Terms with d >= `remove` are removed, those with d >= `generalise` replaced by
their class, wherever they stand in the documents that hold e. A pair counts only if
it stands in at least `min_contexts` distinct contexts, so copies of one passage
prove nothing: the context of a mention are the words next to it, and an occurrence
of a term has the contexts of the mentions it is next to, or else of the nearest one.

Statistics are exact over all documents: terms are counted per task first and
then summed by a shuffle; a pair is counted once for each document. Whole texts are
read again for pairs and for spans; filters of fixed size pass over entities and
pairs that cannot count, and whatever slips through them is joined away.

Defined results: null and empty texts have no spans; repeated rows get equal
spans, also those without an id; long runs of digits or mail characters are scanned in linear time; terms of
one entity that stand in several spans are all marked; other columns are kept by
`sanitise` and not read by `detect`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bagminhash, scratch
from . import text as T
from .fingerprints import pieces

# Kinds in the order in which spans at the same start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("term_removed", "term_generalised")
KINDS = BASE_KINDS + TERM_KINDS

REMOVE, GENERALISE = 0.9, 0.6
MIN_CONTEXTS = 3
CONTEXT_WORDS = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    values = [int(x) for x in digits[::-1]]
    return (sum(values[::2]) + sum(_DOUBLED[x] for x in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at)):
            end = found.end()
            yield start, 0, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Base spans as (start, kind, end) in listing order; code points, end exclusive."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def parsed(text: str) -> list[Span]:
    return [(int(a), KINDS.index(kind), int(b)) for kind, a, b in (x.split(":") for x in text.split(",") if x)]


def _entity(kind: int, value: str) -> int:
    """A 64-bit key of an entity's normal form."""
    normal = value.lower() if kind < 2 else _NOT_DIGIT.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{normal}".encode(), digest_size=8).digest(), "little", signed=True)


_CONTEXT = pa.struct([("entity", pa.int64()), ("context", pa.int64())])
_PAIR = pa.schema([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()), ("n", pa.int64())])
_HIT = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("entity", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("base", pa.string()), ("contexts", pa.list_(_CONTEXT))])
_FOUND_SCHEMA = "doc_id bigint, row_key bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, contexts array<struct<entity: bigint, context: bigint>>"


class Mention(NamedTuple):
    """A mention of an entity: numbers of the words that end before it and that start after it, and of the usable ones next to it."""

    entity: int
    left: int
    right: int
    near: np.ndarray
    context: int


class Terms(NamedTuple):
    """Words of a text (hash, start, end), numbers of the usable ones outside of all base spans, and the text's mentions."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    free: np.ndarray
    mentions: list[Mention]


def _terms(texts: list[str], spans: list[list[Span]]) -> Iterator[Terms]:
    """Terms and mentions of each whole text; a mention's context is made of the usable words within CONTEXT_WORDS words of it."""
    for chunk in T.chunks(pa.array(texts, pa.string())):
        found = T.words(chunk)
        letters = np.concatenate([[0], np.cumsum(T.class_table()[chunk.cps] == T.LETTER)])
        usable = (letters[found.starts + found.lengths] - letters[found.starts] >= 3) if len(found.starts) else np.zeros(0, bool)
        for k in range(chunk.rows):
            first, last = int(found.bounds[k]), int(found.bounds[k + 1])
            starts = found.starts[first:last] - int(chunk.bounds[k])
            ends = starts + found.lengths[first:last]
            hashes, own = found.hashes[first:last].view(np.int64), spans[chunk.first + k]
            free = usable[first:last].copy()
            for a, _, b in own:
                free[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = False
            mentions = []
            for a, kind, b in own:
                left, right = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
                near = np.r_[max(0, left - CONTEXT_WORDS) : left, right : min(len(starts), right + CONTEXT_WORDS)]
                near = near[free[near]]
                context = int(np.bitwise_xor.reduce(T.mix64(hashes[near].view(np.uint64) + np.arange(len(near), dtype=np.uint64)), initial=np.uint64(0)).astype(np.uint64).view(np.int64))
                mentions.append(Mention(_entity(kind, texts[chunk.first + k][a:b]), left, right, near, context))
            yield Terms(hashes, starts, ends, np.flatnonzero(free), mentions)


def term_contexts(terms: Terms, mentions: list[Mention]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, context) of a text with the mentions of one entity in page order, and 1 at the first of each term."""
    beside = np.concatenate([m.near for m in mentions])
    context = np.concatenate([np.full(len(m.near), m.context, np.int64) for m in mentions])
    far = np.setdiff1d(terms.free, beside)
    left, right = np.array([m.left for m in mentions]), np.array([m.right for m in mentions])
    after = np.searchsorted(left, far, "right")  # the first mention after each word
    before, after = np.maximum(after - 1, 0), np.minimum(after, len(mentions) - 1)
    ahead = np.where(left[after] > far, left[after] - far, len(terms.hashes) + 1)
    behind = np.where(left[before] <= far, far - right[before] + 1, len(terms.hashes) + 1)
    nearest = np.where(behind <= ahead, before, after)
    term = terms.hashes[np.concatenate([beside, far])]
    context = np.concatenate([context, np.array([m.context for m in mentions], np.int64)[nearest]])
    order = np.lexsort((context, term))
    term, context = term[order], context[order]
    new = np.ones(len(term), bool)
    new[1:] = term[1:] != term[:-1]
    kept = new.copy()
    kept[1:] |= context[1:] != context[:-1]
    return term[kept], context[kept], new[kept].astype(np.int64)


def _find(docs: DataFrame) -> DataFrame:
    """Base spans of every text, with the entities and contexts of its mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in pieces(batch):
                spans = [base_spans(x) for x in texts]
                some = [k for k, x in enumerate(spans) if x]
                near: list[list[dict]] = [[] for _ in texts]
                for k, terms in zip(some, _terms([texts[k] for k in some], [spans[k] for k in some]), strict=True):
                    near[k] = [{"entity": m.entity, "context": m.context} for m in terms.mentions]
                names = [joined(x) for x in spans]
                counts = [[sum(s[1] == kind for s in x) for x in spans] for kind in range(len(BASE_KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), batch.column(2).slice(at, len(ids)), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]), pa.array(names, pa.string()), pa.array(near, pa.list_(_CONTEXT))],
                    schema=_FOUND,
                )
                at += len(ids)

    return docs.select("doc_id", "text", "row_key").mapInArrow(scratch.lean(run), _FOUND_SCHEMA)


def _holding(batch: pa.RecordBatch, bits: np.ndarray) -> Iterator[tuple[int, Terms, dict[int, list[Mention]]]]:
    """Number, terms and mentions by entity of the rows that hold an entity of the filter."""
    at = 0
    for ids, texts in pieces(batch):
        spans = [base_spans(x) for x in texts]
        some = [k for k, x in enumerate(spans) if x and _in(np.array([_entity(kind, texts[k][a:b]) for a, kind, b in x], np.int64), bits).any()]
        for k, terms in zip(some, _terms([texts[k] for k in some], [spans[k] for k in some]), strict=True):
            by: dict[int, list[Mention]] = {}
            for m, held in zip(terms.mentions, _in(np.array([m.entity for m in terms.mentions], np.int64), bits), strict=True):
                if held:
                    by.setdefault(m.entity, []).append(m)
            yield at + k, terms, by
        at += len(ids)


def _in(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = bagminhash._places(pa.array(keys, pa.int64()))
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _pairs(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, term, context, n of whole documents: n is 1 once for each pair of a document."""
    bits = docs.sparkSession.sparkContext.broadcast(bagminhash._filter_of(docs.sparkSession, entities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, terms, by in _holding(batch, bits.value):
                for entity, mentions in by.items():
                    term, context, n = term_contexts(terms, mentions)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), entity, np.int64)), pa.array(term), pa.array(context), pa.array(n)], schema=_PAIR)

    return docs.select("doc_id", "text").mapInArrow(scratch.lean(run), "entity bigint, term bigint, context bigint, n bigint")


def _occurrences(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, row_key, entity, term, start, end of all occurrences of marked pairs, and perhaps of a few others."""
    keys = marked.select(F.explode(F.array("entity", F.col("entity").bitwiseXOR(F.col("term")))).alias("key"))
    bits = docs.sparkSession.sparkContext.broadcast(bagminhash._filter_of(docs.sparkSession, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, terms, by in _holding(batch, bits.value):
                for entity in by:
                    at = terms.free[_in(terms.hashes[terms.free] ^ np.int64(entity), bits.value)]
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([batch.column(c)[k].as_py()] * n, pa.int64()) for c in (0, 2)), pa.array(np.full(n, entity, np.int64)), pa.array(terms.hashes[at]), pa.array(terms.starts[at].astype(np.int32)), pa.array(terms.ends[at].astype(np.int32))],
                        schema=_HIT,
                    )

    return docs.select("doc_id", "text", "row_key").mapInArrow(scratch.lean(run), "doc_id bigint, row_key bigint, entity bigint, term bigint, start int, end int")


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n_docs over all documents: counted in each task before the shuffle."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (terms, counts)
            if not held or not len(terms):
                return new, n
            every, back = np.unique(np.concatenate([terms, new]), return_inverse=True)
            return every, np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)

        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                found = T.words(chunk)
                row = np.repeat(np.arange(chunk.rows), np.diff(found.bounds))
                order = np.lexsort((found.hashes, row))
                h, r = found.hashes[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                held.append(h[first])
                size += int(first.sum())
            if size > 4_000_000:
                terms, counts = merged()
                held, size = [], 0
                if len(terms) > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], schema=schema)
                    terms, counts = terms[:0], counts[:0]
        terms, counts = merged()
        for k in range(0, len(terms), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[k : k + 200_000].view(np.int64)), pa.array(counts[k : k + 200_000].astype(np.int64))], schema=schema)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scratch.lean(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(docs: DataFrame, found: DataFrame, *, remove: float, generalise: float, min_contexts: int) -> DataFrame:
    """entity, term, kind for the pairs whose disclosure reaches a threshold."""
    mentions = found.select(F.explode("contexts").alias("c")).select("c.entity", "c.context").distinct()
    some = mentions.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= min_contexts).select("entity")
    placed = _pairs(docs, some).groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))
    pairs = placed.groupBy("entity", "term").agg(F.count("*").alias("n_contexts"), F.sum("n").alias("n_pair"))
    entities = found.select(F.explode(F.array_distinct("contexts.entity")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    frequent = pairs.filter(F.col("n_contexts") >= min_contexts).join(entities, "entity")
    total = F.lit(found.count())
    scored = frequent.join(term_counts(docs), "term").filter(F.col("n_entity") < total)
    share = F.log(F.col("n_pair") * total / (F.col("n_entity") * F.greatest("n_term", "n_pair"))) / F.log(total / F.col("n_entity"))
    kind = F.when(F.col("d") >= remove, len(BASE_KINDS)).when(F.col("d") >= generalise, len(BASE_KINDS) + 1)
    return scored.withColumn("d", share).withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("entity", "term", "kind")


def _term_spans(docs: DataFrame, found: DataFrame, **thresholds) -> DataFrame:
    """doc_id, row_key, terms: the spans that the method adds."""
    marked = scratch.materialise(disclosing(docs, found, **thresholds), "pii-terms")
    # a mail address of every page is a hot entity: few marked pairs are broadcast, many salted
    hit = bagminhash.looked_up(_occurrences(docs, marked), marked, ["entity", "term"], marked.count()).filter("kind is not null").select("doc_id", "row_key", "start", "end", "kind")
    least = hit.groupBy("doc_id", "row_key", "start", "end").agg(F.min("kind").alias("kind"))
    return least.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", F.col("kind").cast("int").alias("kind"), "end")).alias("terms"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).try_cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row_key"))


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """Base spans and added spans of every document, with counts of the base kinds."""
    plain = _keyed(docs, id_col, text_col)
    found = scratch.materialise(_find(plain), "pii-found")
    terms = _term_spans(plain, found, remove=remove, generalise=generalise, min_contexts=min_contexts)
    names = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256"]
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [base if not more else joined(sorted(parsed(base) + [(x["start"], x["kind"], x["end"]) for x in more])) for base, more in zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(spans, pa.string())], names=["doc_id", *names, "spans"])

    both = found.join(terms, found["doc_id"].eqNullSafe(terms["doc_id"]) & (found["row_key"] == terms["row_key"]), "left")
    return both.select(found["doc_id"], *names, "base", "terms").mapInArrow(scratch.lean(run), schema)


def replaced(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced by their class; where spans overlap, the first stands for all."""
    out: list[str] = []
    end = 0
    for start, kind, stop in sorted(spans):
        if start >= end:
            out.append(text[end:start])
            if kind < len(BASE_KINDS):
                out.append(f"[{KINDS[kind].upper()}]")
            elif KINDS[kind] == "term_generalised":
                word = text[start:stop]
                out.append("[NAME]" if word[:1].isupper() else "[TERM]")
        end = max(end, stop)
    out.append(text[end:])
    return "".join(out)


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """The same rows and columns with sanitised texts (null stays null); base spans are found again in place, only added spans are joined."""
    plain = _keyed(docs, id_col, text_col)
    with scratch.scope(docs.sparkSession):
        found = scratch.materialise(_find(plain), "pii-found")
        terms = scratch.materialise(_term_spans(plain, found, remove=remove, generalise=generalise, min_contexts=min_contexts), "pii-spans", outer=True)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(0).flatten()
            texts, more = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [None if x is None else replaced(x, base_spans(x) + [(y["start"], y["kind"], y["end"]) for y in terms or ()]) for x, terms in zip(texts, more, strict=True)]
            columns = [pa.array(out, pa.string()) if name == text_col else fields[k] for k, name in enumerate(schema.names)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    text = F.col(text_col).cast("string")
    key = docs.select(F.struct("*").alias("row"), text.alias("_text"), F.col(id_col).try_cast("bigint").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"))
    both = key.join(terms, key["_id"].eqNullSafe(terms["doc_id"]) & (key["_key"] == terms["row_key"]), "left")
    return both.select("row", "_text", "terms").mapInArrow(scratch.lean(run), schema)  # the row stays a struct, whatever its columns' names
