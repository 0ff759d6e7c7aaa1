"""Seeded samples and scores of rated samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import prng, stats
from cairnfield.operators.classify import dedupe
from cairnfield.operators.lookups import numbered

PER_LABEL, UNKNOWN_N, SEED = 20, 40, 20261005  # fixed values of the sample


def weighted_draw(items: DataFrame, weight: Column, k: int, seed: int, order: list[Column]) -> DataFrame:
    """k rows without replacement, by the largest u ** (1 / weight), where u is the draw of the row's place; all rows, in order, if there are no more than k."""
    placed = numbered(items, order)
    key = F.pow(prng.draw(seed, F.col("_pos")), F.lit(1.0) / F.greatest(weight, F.lit(1e-9)))
    return placed.withColumn("_key", key).orderBy(F.desc("_key"), "_pos").limit(k).drop("_key", "_pos")


def subsample(first: DataFrame, rest: DataFrame, target: int, seed: int, order: list[Column], *, with_artifact: float = 2.0, other: float = 1.0) -> DataFrame:
    """All hosts of the first pool (its first rows in order), and enough of the others, drawn with a weight for hosts that have a document."""
    census = dedupe(first, ["host"], order)
    pool = rest.join(census.select("host"), "host", "left_anti")
    need = max(0, target - census.count())
    drawn = weighted_draw(pool, F.when(F.col("artifact"), with_artifact).otherwise(other), need, seed, order)
    return census.unionByName(drawn)


def taken_by_source(sample: DataFrame) -> DataFrame:
    return sample.groupBy("source").agg(F.count("*").alias("taken"), F.count_if("artifact").alias("taken_with_artifact"))


def _drawn(rows: DataFrame, stratum: str, order: list[Column], strata: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows at the first places of their stratum after a seeded shuffle of it, with `place` in the whole sample, and the strata with `drawn`.

    One stream of draws serves all strata, in the order of `strata` (stratum, ord, pool, want), and then the shuffle of the
    sample. What earlier strata use up is a prefix sum, and any draw is known by its number, so each stratum is shuffled in a
    task of its own, which knows its size alone; only the items at its first places are joined with the rows.
    """
    spark = rows.sparkSession
    earlier = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # a row a stratum
    taken = F.least("want", "pool")
    sized = strata.withColumns({
        "drawn": taken,
        "_rows": F.coalesce(F.sum("pool").over(earlier), F.lit(0)),
        "_draws": F.coalesce(F.sum(F.when(F.col("want") > 0, F.col("pool") - 1).otherwise(0)).over(earlier), F.lit(0)),
        "_first": F.coalesce(F.sum(taken).over(earlier), F.lit(0)),
    })
    end = sized.agg(F.coalesce(F.sum("drawn"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(F.col("want") > 0, F.col("pool") - 1).otherwise(0)), F.lit(0)).alias("used")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                items = prng.first_places(r["pool"], r["want"], seed, r["_draws"])
                yield pa.RecordBatch.from_arrays([pa.array(items + r["_rows"] + 1, pa.int64()), pa.array(np.arange(len(items)) + r["_first"], pa.int64())], names=["_pos", "_item"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    picks = sized.filter("want > 0").select("ord", "pool", "want", "_rows", "_draws", "_first").repartition(parts, "ord").mapInArrow(run, "_pos BIGINT, _item BIGINT")
    last = prng.shuffled(spark, end["m"], seed, end["used"]).select(F.col("item").alias("_item"), "place")
    placed = numbered(rows.join(F.broadcast(strata.select(stratum, "ord")), stratum), [F.col("ord"), *order])
    sample = placed.join(picks.join(last, "_item"), "_pos").drop("_pos", "_item", "ord")
    return sample, sized.drop("_rows", "_draws", "_first")


def stratified(pool: DataFrame, order: list[Column], *, label: str = "predicted", per_label: int = PER_LABEL, unknown_n: int = UNKNOWN_N, min_hosts: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A sample of each label of a pool (its rows in `order`) with the place of each row in it, and (label, pool, drawn): unreachable hosts and labels of few hosts give none."""
    counts = pool.groupBy(label).agg(F.count("*").alias("pool"))
    want = F.when(F.col(label) == "unknown", unknown_n).when((F.col(label) == "unreachable") | (F.col("pool") < (per_label if min_hosts is None else min_hosts)), 0).otherwise(per_label)
    strata = counts.withColumns({"want": want, "ord": F.row_number().over(Window.orderBy(label))})
    sample, sized = _drawn(pool, label, order, strata, seed)
    return sample, sized.select(F.col(label).alias("label"), "pool", "drawn")


def half_matched(candidates: DataFrame, order: list[Column], n: int = 100, seed: int = 7, matched: str = "matched") -> DataFrame:
    """n rows for rating with their places, half of them matched; missing matched ones are made up by others, not the other way round."""
    counts = candidates.groupBy(matched).agg(F.count("*").alias("pool"))
    size = counts.agg(F.coalesce(F.max(F.when(F.col(matched), F.col("pool"))), F.lit(0))).first()[0]
    strata = counts.select(matched, "pool", F.when(F.col(matched), n // 2).otherwise(n - min(n // 2, size)).alias("want"), F.when(F.col(matched), 0).otherwise(1).alias("ord"))
    return _drawn(candidates, matched, order, strata, seed)[0]


# ---------------------------------------------------------------------------------------------------------------------
# scores


def rated(sample: DataFrame, truth: DataFrame) -> DataFrame:
    """host, predicted, truth; truth is null where it is blank, `?` or missing, and `none` is unknown."""
    t = F.lower(F.trim(F.coalesce("truth", F.lit(""))))
    value = F.when((t == "") | (t == "?"), F.lit(None).cast("string")).when(t == "none", "unknown").otherwise(t)
    return sample.select("host", "predicted").join(truth.select("host", "truth"), "host", "left").select("host", "predicted", value.alias("truth"))


def label_scores(pairs: DataFrame) -> DataFrame:
    """Precision and recall of every label that was predicted or true; null without rows to divide by."""
    known = pairs.filter("truth is not null")
    sides = known.select(F.explode(F.array(F.struct(F.col("predicted").alias("label"), F.lit(1).alias("p"), F.lit(0).alias("t"), (F.col("predicted") == F.col("truth")).cast("int").alias("tp")), F.struct(F.col("truth").alias("label"), F.lit(0).alias("p"), F.lit(1).alias("t"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    agg = sides.groupBy("label").agg(F.sum("p").alias("predicted"), F.sum("t").alias("truth"), F.sum("tp").alias("tp"))
    return agg.withColumns({"precision": stats.ratio(F.col("tp"), F.col("predicted")), "recall": stats.ratio(F.col("tp"), F.col("truth"))})


def overall(pairs: DataFrame) -> DataFrame:
    """Rows, rated rows, accuracy and Cohen's kappa (1 if chance alone would agree)."""
    counts = pairs.agg(F.count("*").alias("n"), F.count("truth").alias("rated"), F.count_if(F.col("predicted") == F.col("truth")).alias("agree"))
    chance = label_scores(pairs).agg(F.coalesce(F.sum(F.col("predicted").cast("double") * F.col("truth")), F.lit(0.0)).alias("c"))
    both = counts.withColumn("_k", F.lit(1)).join(F.broadcast(chance.withColumn("_k", F.lit(1))), "_k").drop("_k")
    n = F.greatest(F.col("rated"), F.lit(1)).cast("double")
    po, pe = F.col("agree") / n, F.col("c") / (n * n)
    return both.select("n", "rated", (F.col("n") - F.col("rated")).alias("undecidable"), po.alias("accuracy"), F.when(pe == 1, 1.0).otherwise((po - pe) / (F.lit(1.0) - pe)).alias("kappa"))


def confusions(pairs: DataFrame) -> DataFrame:
    return pairs.filter("truth is not null and predicted <> truth")
