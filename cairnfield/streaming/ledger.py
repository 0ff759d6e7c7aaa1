"""A table that batches are appended to, each key once, by a commit protocol.

A batch's rows are written to a folder of their own and become part of the table
when a marker is published, which happens whole or not at all; the rows of a
batch that was killed are never seen and are replaced when it comes again, and a
batch that has been committed is skipped. Keys that are done stand in buckets by
their hash; a batch reads the buckets of its own keys alone, and the number of
buckets doubles as the table grows, so that a bucket holds about `bucket_rows`
keys at most and what a batch reads follows its own keys, not the table.

Folders: `rows/ledger_batch=N`, `keys/gen=G/ledger_batch=N/ledger_bucket=B`, `_commits/N.json`.
Batches of one table are appended one after another; of two writers that append
at the same time, the second fails at its marker and may try again.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnfield.sources import commit

BUCKETS, BUCKET_ROWS = 16, 200_000


class Ledger:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], *, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.first_buckets, self.bucket_rows = buckets, bucket_rows

    # ------------------------------------------------------------------------------------------------------- markers

    def _marker(self, number: int) -> str:
        return f"{self.path}/_commits/{number:012d}.json"

    def numbers(self) -> list[int]:
        """Numbers of the committed batches."""
        return [int(x.removesuffix(".json")) for x in commit.names(self.spark, f"{self.path}/_commits") if x.endswith(".json")]

    def state(self) -> dict:
        """The last marker: its number, the generation and number of buckets, the rows of the table, the last batch of each writer, and its schema."""
        done = self.numbers()
        if not done:
            return {"number": -1, "gen": 0, "buckets": self.first_buckets, "rows": 0, "writers": {}, "since": 0}
        return json.loads(commit.read_text(self.spark, self._marker(done[-1])))

    # ---------------------------------------------------------------------------------------------------------- keys

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def done_keys(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """Keys of committed batches, in some buckets or in all."""
        folder = f"{self.path}/keys/gen={state['gen']}"
        stored = self.spark.read.option("basePath", folder).parquet(folder).filter((F.col("ledger_batch") >= state["since"]) & (F.col("ledger_batch") <= state["number"]))
        return stored if buckets is None else stored.filter(F.col("ledger_bucket").isin(buckets))

    def _write_keys(self, rows: DataFrame, gen: int, buckets: int, number: int) -> None:
        keyed = rows.select(*self.keys).withColumn("ledger_bucket", self._bucket(buckets))
        keyed.repartition("ledger_bucket").write.partitionBy("ledger_bucket").parquet(f"{self.path}/keys/gen={gen}/ledger_batch={number}")

    # -------------------------------------------------------------------------------------------------------- append

    def append(self, batch: DataFrame, batch_id: int, writer: str = "") -> int:
        """Adds the rows whose keys aren't there yet, one for each key; returns how many. A batch that was added before adds nothing."""
        state = self.state()
        if batch_id <= state["writers"].get(writer, -1):
            return 0
        number, gen, buckets = state["number"] + 1, state["gen"], state["buckets"]
        for left in (f"rows/ledger_batch={number}", f"keys/gen={gen}/ledger_batch={number}", f"keys/gen={gen + 1}"):  # of an attempt that was killed
            commit.remove(self.spark, f"{self.path}/{left}")
        new = batch.dropDuplicates(self.keys)
        if state["rows"]:
            # as many numbers as there are buckets at most
            touched = [r[0] for r in new.select(self._bucket(buckets)).distinct().collect()]
            done = self.done_keys(state, touched).select(*[F.col(k).alias(f"_done_{k}") for k in self.keys])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in self.keys])
            new = new.join(done, same, "left_anti")
        folder = f"{self.path}/rows/ledger_batch={number}"
        new.write.parquet(folder)
        # counts and keys come from what was written, whatever a second evaluation of the batch would give
        added = self.spark.read.schema(batch.schema).parquet(folder)
        n = added.count()
        since, rows = state["since"], state["rows"] + n
        if rows > buckets * self.bucket_rows:
            while rows > buckets * self.bucket_rows // 2:
                buckets *= 2
            every = added.select(*self.keys)
            every = every.unionByName(self.done_keys(state).select(*self.keys)) if state["rows"] else every
            gen, since = gen + 1, number
            self._write_keys(every, gen, buckets, number)
        elif n:
            self._write_keys(added, gen, buckets, number)
        marker = {"number": number, "gen": gen, "buckets": buckets, "rows": rows, "added": n, "since": since, "writers": state["writers"] | {writer: batch_id}, "schema": json.loads(batch.schema.json())}
        commit.publish(self.spark, self._marker(number), json.dumps(marker))
        if gen != state["gen"]:
            commit.remove(self.spark, f"{self.path}/keys/gen={state['gen']}")
        return n

    def rows(self) -> DataFrame:
        """The table: rows of committed batches."""
        state = self.state()
        if state["number"] < 0:
            raise FileNotFoundError(f"{self.path}: nothing was committed yet")
        schema = StructType.fromJson(state["schema"])
        folder = f"{self.path}/rows"
        # the folder of an unfinished batch has a number beyond the last marker's
        return self.spark.read.schema(schema.add("ledger_batch", "integer")).option("basePath", folder).parquet(folder).filter(F.col("ledger_batch") <= state["number"]).drop("ledger_batch")


def append_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str], *, available_now: bool = False, **options):
    """Appends a stream to a ledger. The query's id, which its checkpoint keeps, tells its batches from those of other streams."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        Ledger(spark, path, keys, **options).append(batch, batch_id, writer)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
