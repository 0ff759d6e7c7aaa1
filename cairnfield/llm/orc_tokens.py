"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Rows are range-partitioned by document id, encoded, and written as one file a
partition in ascending order, so row-group indexes and Bloom filters prune by id
and stripes can be read in parallel.

Defined results: a null or empty text has only the end id; repeated rows (same
id) are all kept, ordered by text; an empty table gives empty files; other
columns are not read, and ids that are no whole numbers are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import tokens as K

FILE_SCHEMA = "part int, doc_id bigint, local_start bigint, n_tokens int, ids array<int>"
ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "orc.dictionary.key.threshold": "0"}
_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])


def encode_ordered(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of FILE_SCHEMA; partitions follow each other by ascending id, and so do rows inside them."""
    path = tokenizer or K.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = K.encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for done in encoder.encode(batch.column(1)):
                n = np.diff(done.bounds) + 1
                ends = np.cumsum(n)
                ids = np.full(int(ends[-1]), end_id, np.int32)
                keep = np.ones(len(ids), bool)
                keep[ends - 1] = False
                ids[keep] = done.ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                rows = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, part, np.int32)), batch.column(0).slice(done.first, rows), pa.array(at + ends - n), pa.array(n.astype(np.int32)), lists], schema=_ARROW)
                at += int(ends[-1])

    plain = docs.select(F.col(id_col).try_cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = files or scratch.partitions(docs.sparkSession)
    return plain.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(scratch.lean(run, "tokens"), FILE_SCHEMA)


def write(docs: DataFrame, path: str, **options) -> str:
    """Encodes a table of documents and writes it as ORC; returns the path."""
    encode_ordered(docs, **options).write.options(**ORC_OPTIONS).orc(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id: ORC skips files, stripes and row groups by their statistics and Bloom filters."""
    return read(spark, path).filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def with_starts(stored: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before a row: totals by file (one row each) are summed up and joined back."""
    from pyspark.sql import Window

    totals = stored.groupBy("part").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return stored.join(F.broadcast(offsets), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def ids_crc32(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the ids that were read."""
    import zlib

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    return stored.select("doc_id", "start", "ids").mapInArrow(scratch.lean(run, "tokens"), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
