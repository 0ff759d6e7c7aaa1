"""Lookups, resumption, shards and first-or-last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import hosts as H
from cairnfield.operators.classify import dedupe


def backfill_ranks(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """rank from the first rank of each host, else the one a row has; `ranked` tells which rows matched."""
    first = dedupe(ranks.filter(F.col("rank").isNotNull()), ["host"], [F.col("pos")]).select("host", F.col("rank").alias("_rank"))
    return rows.join(first, "host", "left").withColumn("ranked", F.col("_rank").isNotNull()).withColumn("rank", F.coalesce("_rank", "rank")).drop("_rank")


def rank_for(hosts: DataFrame, ranks: DataFrame, registrable: Column) -> DataFrame:
    """The rank of a host itself, else of its registrable domain unless that is a wildcard service."""
    named = hosts.withColumn("_reg", registrable)
    usable = F.when((F.col("_reg") != F.col("host")) & ~F.col("_reg").isin(*H.WILDCARD_DNS), F.col("_reg"))
    exact = ranks.select(F.col("host"), F.col("rank").alias("_exact"))
    outer = ranks.select(F.col("host").alias("_key"), F.col("rank").alias("_outer"))
    found = named.join(exact, "host", "left").withColumn("_key", usable).join(outer, "_key", "left")
    return found.withColumn("rank", F.coalesce("_exact", "_outer")).drop("_reg", "_key", "_exact", "_outer")


def to_do(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't done yet."""
    return rows.join(done.select(*keys), keys, "left_anti")


def shard(rows: DataFrame, index: int, count: int, order: list[Column]) -> DataFrame:
    """Every `count`-th row from `index` in the order of the whole table.

    The positions come from a range sort: rows of earlier partitions are counted
    first, so no single task orders the table.
    """
    if not 0 <= index < count:
        raise ValueError(f"shard index must be in 0..{count - 1}")
    return numbered(rows, order).filter((F.col("_pos") - 1) % count == index).drop("_pos")


def numbered(rows: DataFrame, order: list[Column], name: str = "_pos") -> DataFrame:
    """Adds the place of each row (from 1) in a total order, by a range sort and counts per partition."""
    import uuid

    from cairnfield.sources import scratch

    ranged = rows.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_line", F.monotonically_increasing_id())
    # written once: a second evaluation might cut the ranges elsewhere
    made = scratch.written(ranged, f"numbered-{uuid.uuid4().hex}")
    counts = made.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_line"))
    return made.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_line", "_before")


def shards(rows: DataFrame, count: int, order: list[Column]) -> DataFrame:
    """Adds the shard (from 0) that each row belongs to; the table is numbered once."""
    return numbered(rows, order).withColumn("shard", (F.col("_pos") - 1) % count).drop("_pos")


def parse_shard(text: str) -> tuple[int, int]:
    """`i/n` as (i, n)."""
    index, _, count = text.strip().partition("/")
    if not (index.isdigit() and count.isdigit() and int(index) < int(count)):
        raise ValueError(f"shard must be i/n with i < n, not {text!r}")
    return int(index), int(count)


def frequency(rows: DataFrame, key: str, pos: str, k: int | None = None) -> DataFrame:
    """Counts of a key, the most frequent first; ties go to the one seen first."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))
    ordered = counted.orderBy(F.desc("n"), "first_pos")
    return ordered.limit(k) if k else ordered
