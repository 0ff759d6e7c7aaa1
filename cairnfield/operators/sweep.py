"""Points inside of windows, without a key to join on: both sides are dealt along the line and swept in sorted order.

The line is cut into at most BINS bins; of each, only the number of points and of
windows that start and end there reach the driver. Runs of bins with about as
many pairs as others are a slot; a bin with more pairs than that is a slot of its
own and is tiled over points and windows, so that a crowded moment doesn't stand
in one task. Inside a tile, points are sorted and each window takes its run of
them by binary search, so work follows the pairs that come out.

Where only numbers and sums of points are asked for, `totals` makes no pairs:
what stands before an edge of a window is a running sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 65_536
TILE_PAIRS = 500_000
MIN_SLOTS = 32


def _slots(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, tile_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each bin, and by slot into how many parts its points and its windows are cut."""
    active = np.cumsum(starts) - np.concatenate([[0], np.cumsum(ends)[:-1]])  # windows that touch a bin
    cost = points * active
    target = max(1.0, min(float(tile_pairs), cost.sum() / MIN_SLOTS))
    slot, cuts_p, cuts_w, filled = np.zeros(len(points), np.int64), [1], [1], 0.0
    for b, own in enumerate(cost.tolist()):
        if own > target:  # a slot of its own, unless it is the first bin of one
            if filled:
                cuts_p.append(1)
                cuts_w.append(1)
            tiles = own / target
            p = min(max(1.0, np.sqrt(tiles * points[b] / active[b])), tiles)
            cuts_p[-1], cuts_w[-1] = int(np.ceil(p)), int(np.ceil(tiles / p))
            filled = float("inf")
        elif filled + own > target:
            cuts_p.append(1)
            cuts_w.append(1)
            filled = own
        else:
            filled += own
        slot[b] = len(cuts_p) - 1
    return slot, np.array(cuts_p, np.int64), np.array(cuts_w, np.int64)


def _runs(at: str, lo: str, hi: str, columns: list[str], names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def sweep(windows: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by(at)
        line = points.column(at).to_numpy()
        first = np.searchsorted(line, windows.column(lo).to_numpy(), "left")
        count = np.searchsorted(line, windows.column(hi).to_numpy(), "right") - first
        count = np.maximum(count, 0)
        stop = np.cumsum(count)
        total = int(stop[-1]) if len(stop) else 0
        where = np.arange(total) + np.repeat(first - stop + count, count)
        left, right = windows.take(pa.array(np.repeat(np.arange(len(count)), count))), points.take(pa.array(where))
        return pa.Table.from_arrays([left.column(c) for c in columns] + [right.column(c) for c in names], names=[*columns, *names])

    return sweep


def in_windows(windows: DataFrame, points: DataFrame, lo: Column, hi: Column, at: Column, *, tile_pairs: int = TILE_PAIRS) -> DataFrame:
    """All pairs of a window (both ends, longs, belong to it) and a point inside, with the columns of both (no name may stand on both sides).

    Equal rows are joined once and multiplied afterwards. Windows that end before they start hold nothing, and rows without a place match nothing.
    """
    spark = windows.sparkSession
    if clash := set(windows.columns) & set(points.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    w = windows.groupBy(*windows.columns).agg(F.count("*").alias("_nw")).withColumns({"_lo": lo.cast("bigint"), "_hi": hi.cast("bigint")}).filter("_hi >= _lo")
    p = points.groupBy(*points.columns).agg(F.count("*").alias("_np")).withColumn("_at", at.cast("bigint")).filter("_at is not null")
    schema = f"{_ddl(w, ('_lo', '_hi'))}, {_ddl(p, ('_at',))}"
    columns, names = [c for c in w.columns if c not in ("_lo", "_hi")], [c for c in p.columns if c != "_at"]
    edge = p.agg(F.min("_at").alias("first"), F.max("_at").alias("last")).first()
    if edge["first"] is None:
        return spark.createDataFrame([], schema).drop("_nw", "_np")
    first, last = edge["first"], edge["last"]
    width = (last - first) // BINS + 1
    bin_of = lambda c: F.floor((c - first) / width).cast("int")
    w = w.filter((F.col("_hi") >= first) & (F.col("_lo") <= last))
    w = w.withColumns({"_b0": bin_of(F.greatest("_lo", F.lit(first))), "_b1": bin_of(F.least("_hi", F.lit(last)))})
    p = p.withColumn("_b", bin_of(F.col("_at")))
    # at most BINS rows of counts
    ends = w.select(F.explode(F.array(F.struct(F.col("_b0").alias("b"), F.lit(0).alias("p"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("_b1").alias("b"), F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x")).select("x.*")
    counts = p.select(F.col("_b").alias("b"), F.lit(1).alias("p"), F.lit(0).alias("s"), F.lit(0).alias("e")).unionByName(ends).groupBy("b").agg(F.sum("p").alias("p"), F.sum("s").alias("s"), F.sum("e").alias("e")).toPandas()
    size = int((last - first) // width) + 1
    by = np.zeros((3, size), np.int64)
    by[:, counts["b"].to_numpy()] = counts[["p", "s", "e"]].to_numpy().T
    slot, cuts_p, cuts_w = _slots(*by, tile_pairs)
    # bins and slots are at most BINS rows each, and so may be sent to all tasks
    bins = F.broadcast(spark.createDataFrame(pa.table({"b": np.arange(size, dtype=np.int32), "slot": slot})))
    cuts = F.broadcast(spark.createDataFrame(pa.table({"_slot": np.arange(len(cuts_p)), "_cp": cuts_p, "_cw": cuts_w})))
    from_slot, to_slot = bins.select(F.col("b").alias("_b0"), F.col("slot").alias("_s0")), bins.select(F.col("b").alias("_b1"), F.col("slot").alias("_s1"))
    w = w.join(F.broadcast(from_slot), "_b0").join(F.broadcast(to_slot), "_b1").withColumn("_slot", F.explode(F.sequence("_s0", "_s1"))).join(cuts, "_slot")
    w = w.withColumn("_j", F.pmod(F.xxhash64(*columns), F.col("_cw"))).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cp") - 1)))
    p = p.join(F.broadcast(bins.select(F.col("b").alias("_b"), F.col("slot").alias("_slot"))), "_b").join(cuts, "_slot")
    p = p.withColumn("_i", F.pmod(F.xxhash64(*names), F.col("_cp"))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cw") - 1)))
    key = ["_slot", "_i", "_j"]
    made = w.select(*key, *columns, "_lo", "_hi").groupBy(*key).cogroup(p.select(*key, *names, "_at").groupBy(*key)).applyInArrow(_runs("_at", "_lo", "_hi", columns, names), schema)
    whole = made.withColumn("_n", F.col("_nw") * F.col("_np")).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    return whole.drop("_n", "_nw", "_np")


def totals(windows: DataFrame, points: DataFrame, lo: Column, hi: Column, at: Column, total: Column) -> DataFrame:
    """The windows (both ends, longs, belong to them) that hold points, with their number `hits` and the exact sum `total` of a column of longs over them.

    A window's figures are those up to its end less those before its start, so work follows rows, not pairs. Points of a place are one row, as are
    equal edges, and running sums stand inside of bins of the line, so a crowded moment is short. A sum of nulls alone is null.
    """
    number = total.cast("decimal(20,0)")
    p = points.select(at.cast("bigint").alias("_at"), number.alias("_s")).filter("_at is not null").groupBy("_at").agg(F.count("*").alias("_n"), F.count("_s").alias("_m"), F.coalesce(F.sum("_s"), F.lit(0)).alias("_s"))
    edge = p.agg(F.min("_at").alias("first"), F.max("_at").alias("last")).first()
    first, last = (edge["first"], edge["last"]) if edge["first"] is not None else (0, -1)
    w = windows.withColumns({"_lo": lo.cast("bigint"), "_hi": hi.cast("bigint")}).filter((F.col("_hi") >= F.col("_lo")) & (F.col("_hi") >= first) & (F.col("_lo") <= last))
    w = w.withColumns({"_lo": F.greatest("_lo", F.lit(first)), "_hi": F.least("_hi", F.lit(last))})
    width = max(last - first, 0) // BINS + 1
    place = F.floor((F.col("_at") - first) / width).cast("int").alias("_b")
    # at a place, starts come before points and ends after them
    edges = w.select(F.explode(F.array(F.struct(F.col("_lo").alias("_at"), F.lit(0).alias("_k")), F.struct(F.col("_hi").alias("_at"), F.lit(2).alias("_k")))).alias("x")).select("x.*").distinct()
    rows = p.withColumn("_k", F.lit(1)).unionByName(edges, allowMissingColumns=True).select("_at", "_k", "_n", "_m", "_s", place)
    sums = ("_n", "_m", "_s")
    up_to = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most BINS rows of sums stand in one task, and may be sent to all
    bins = rows.groupBy("_b").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    bins = bins.select("_b", *[(F.sum(c).over(up_to([], "_b")) - F.col(c)).alias(f"{c}_b") for c in sums])
    made = rows.select("_b", "_at", "_k", *[F.coalesce(F.sum(c).over(up_to(["_b"], "_at", "_k")), F.lit(0)).alias(c) for c in sums]).filter("_k <> 1")
    made = made.join(F.broadcast(bins), "_b").select("_at", "_k", *[(F.col(c) + F.col(f"{c}_b")).alias(c) for c in sums])
    before = made.filter("_k = 0").select(F.col("_at").alias("_lo"), *[F.col(c).alias(f"{c}0") for c in sums])
    until = made.filter("_k = 2").select(F.col("_at").alias("_hi"), *[F.col(c).alias(f"{c}1") for c in sums])
    held = w.join(before, "_lo").join(until, "_hi").filter("_n1 > _n0")
    return held.select(*windows.columns, F.expr("_n1 - _n0").alias("hits"), F.expr("CASE WHEN _m1 > _m0 THEN CAST(_s1 - _s0 AS BIGINT) END").alias("total"))


def _ddl(df: DataFrame, without: tuple[str, ...]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)
