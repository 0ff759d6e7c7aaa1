"""Many literal patterns in texts: one automaton (Aho-Corasick) over all of them, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
_built: dict[str, object] = {}


def automaton(words: list[str]):
    """An automaton that yields the number of each word it meets."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, word in enumerate(words):
        found.add_word(word, k)
    if words:
        found.make_automaton()
    return found


def _blocks(tokens: DataFrame, block_bytes: int) -> int:
    size = tokens.agg(F.coalesce(F.sum(F.octet_length("token") + 16), F.lit(0))).first()[0]
    return -(-int(size) // block_bytes)


def occurrences(rows: DataFrame, text: Column, tokens: DataFrame, keep: list[str], *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep, token: which of the tokens (column token; empty and null ones are in no text) each text holds, each once.

    Distinct tokens are dealt into blocks of about `block_bytes` by hash. A block at a time is sent to the tasks, and the
    texts are read once for each, so neither the driver nor a task holds more than a block, however many tokens there are.
    """
    import uuid

    spark = rows.sparkSession
    distinct = tokens.select(F.col("token").cast("string").alias("token")).filter("token <> ''").distinct()
    n = _blocks(distinct, block_bytes)
    plain = rows.select(*keep, text.cast("string").alias("_text"))
    schema = plain.select(*keep).schema.add("token", "string")
    out = spark.createDataFrame([], schema)
    for k in range(n):
        own = distinct if n == 1 else distinct.filter(F.pmod(F.xxhash64("token"), F.lit(n)) == k)
        words = spark.sparkContext.broadcast(sorted(r["token"] for r in own.collect()))
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], words=words, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _built:  # one automaton a worker
                _built.clear()
                _built[name] = automaton(words.value)
            known = _built[name]
            for batch in batches:
                at, hits = [], []
                for row, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    if value:
                        found = {i for _, i in known.iter(value)}
                        at += [row] * len(found)
                        hits += [words.value[i] for i in sorted(found)]
                left = batch.select(keep).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*left.columns, pa.array(hits, pa.string())], names=[*keep, "token"])

        out = out.unionByName(plain.mapInArrow(run, schema))
    return out


def holding(rows: DataFrame, text: Column, tokens: DataFrame, keep: list[str], **options) -> DataFrame:
    """keep, and the other columns of each token row whose token (column token) the text holds: equal tokens are searched once and joined back."""
    return occurrences(rows, text, tokens, keep, **options).join(tokens, "token").drop("token")
