"""Pairs of 64-bit hashes that differ in few bits, by an index of equal blocks.

The 64 bits are cut into blocks. Hashes that differ in at most d bits differ in
at most d blocks, so of b blocks some b - d are equal: each choice of b - d blocks
is an index, and only hashes that agree on one are compared. A pair is made by
the first choice it agrees on alone. Crowded entries of an index are tiled.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import simhash
from cairnfield.sources import scratch

BITS, BLOCKS = 64, 8
SMALL_ENTRY, TILE_ROWS = 64, 16_384
SLICE_PAIRS = 2_000_000
BROADCAST_ROWS = 100_000


def masks(distance: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks - distance blocks, as signed longs."""
    if not 0 <= distance < blocks <= BITS:
        raise ValueError("blocks must be more than the distance, and 64 at most")
    edges = [k * BITS // blocks for k in range(blocks + 1)]
    block = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(blocks)]
    chosen = [sum(block[k] for k in some) for some in combinations(range(blocks), blocks - distance)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in chosen]


def classes(rows: DataFrame, key: str, h: str) -> DataFrame:
    """h, rep (the least key), n: rows of one hash; those without one count as 0, like texts without tokens."""
    return rows.groupBy(F.coalesce(h, F.lit(0).cast("bigint")).alias("h")).agg(F.min(key).alias("rep"), F.count("*").alias("n"))


def _entries(hashes: DataFrame, chosen: list[int], more_than: int, tile_rows: int) -> DataFrame:
    """choice, entry, tiles, and the columns of `hashes`: every hash at its entry of each index, and into how many tiles the entry is cut if it has more than so many rows (else null)."""
    keyed = hashes.select("*", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m)) for m in chosen])).alias("choice", "entry"))
    crowded = keyed.groupBy("choice", "entry").agg(F.count("*").alias("m")).filter(F.col("m") > more_than).select("choice", "entry", F.ceil(F.col("m") / tile_rows).cast("int").alias("tiles"))
    some = crowded.limit(BROADCAST_ROWS + 1).count()
    if not some:
        return keyed.withColumn("tiles", F.lit(None).cast("int"))
    return keyed.join(F.broadcast(crowded) if some <= BROADCAST_ROWS else crowded, ["choice", "entry"], "left")


def _near(a: DataFrame, b: DataFrame, keys: list[str], distance: int, chosen: list[int]) -> DataFrame:
    """Rows of a (h) and b (other) in one entry that are near, by their first choice."""
    apart = F.col("h").bitwiseXOR(F.col("other"))
    near = a.join(b.hint("merge"), keys).filter((F.col("h") < F.col("other")) & (F.bit_count(apart) <= distance))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, k) for k, m in enumerate(chosen)])
    return near.filter(F.col("choice") == first).withColumn("distance", F.bit_count(apart))


def pairs_within(hashes: DataFrame, distance: int, *, blocks: int = BLOCKS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs (h, other, distance; h < other) of distinct hashes (column h, each once) at most `distance` bits apart."""
    chosen = masks(distance, blocks)
    placed = _entries(hashes.select("h"), chosen, tile_rows, tile_rows).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    a = placed.select("choice", "entry", F.pmod(F.xxhash64("h"), "tiles").cast("int").alias("tile"), "h")
    b = placed.select("choice", "entry", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("h").alias("other"))
    return _near(a, b, ["choice", "entry", "tile"], distance, chosen).select("h", "other", "distance")


def _linked(a: np.ndarray, weight_a: np.ndarray, b: np.ndarray, weight_b: np.ndarray, distance: int, choice: int, chosen: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
    """Counts and weights of the partners of each hash of two tiles (or of one with itself) whose first choice this is."""
    out = np.zeros((4, max(len(a), len(b))), np.int64)
    step = max(1, SLICE_PAIRS // max(1, len(b)))
    for at in range(0, len(a), step):
        apart = a[at : at + step, None] ^ b[None, :]
        i, j = np.nonzero(np.bitwise_count(apart) <= distance)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        x = apart[i, j]
        mine = (x & chosen[choice]) == 0
        for m in chosen[:choice]:
            mine &= (x & m) != 0
        i, j = i[mine] + at, j[mine]
        out[0] += np.bincount(i, minlength=out.shape[1])
        out[1] += np.bincount(i, weight_b[j], minlength=out.shape[1]).astype(np.int64)
        out[2] += np.bincount(j, minlength=out.shape[1])
        out[3] += np.bincount(j, weight_a[i], minlength=out.shape[1]).astype(np.int64)
    return tuple(out)


def link_counts(known: DataFrame, distance: int, *, blocks: int = BLOCKS, small: int = SMALL_ENTRY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """h, links, linked: for each distinct hash (h, n) how many others are at most `distance` bits apart, and the sum of their n; hashes without any are left out.

    Entries of at most `small` hashes are joined. A larger one is cut into tiles, and each pair of tiles is compared inside
    of a task, so work may grow with the square of a cluster, but no row stands for one of its pairs.
    """
    chosen = masks(distance, blocks)
    numbers = np.array(chosen, np.int64).view(np.uint64)
    every = _entries(known.select("h", "n"), chosen, small, tile_rows)
    few = every.filter("tiles is null").drop("tiles")
    pairs = _near(few, few.select("choice", "entry", F.col("h").alias("other"), F.col("n").alias("m")), ["choice", "entry"], distance, chosen)
    ends = pairs.select(F.explode(F.array(F.struct("h", F.col("m").alias("w")), F.struct(F.col("other").alias("h"), F.col("n").alias("w")))).alias("x")).select("x.h", F.lit(1).cast("bigint").alias("links"), F.col("x.w").alias("linked"))
    placed = every.filter("tiles is not null").withColumn("tile", F.pmod(F.xxhash64("h"), "tiles").cast("int"))
    # a tile meets itself, those after it (as the left one) and those before it (as the right one)
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("i"), F.greatest(t, "tile").alias("j")))
    dealt = placed.withColumn("x", F.explode(meets)).select("choice", "entry", "x.i", "x.j", "tile", "h", "n")

    def count(table: pa.Table) -> pa.Table:
        choice, i, j = (table.column(c)[0].as_py() for c in ("choice", "i", "j"))
        tile, h, n = (table.column(c).to_numpy() for c in ("tile", "h", "n"))
        h = h.view(np.uint64)
        left, right = tile == i, tile == j
        found = _linked(h[left], n[left], h[right], n[right], distance, choice, numbers, i == j)
        # of one tile both ends stand in the same list
        hs, links, linked = np.concatenate([h[left], h[right]]), np.concatenate([found[0][: left.sum()], found[2][: right.sum()]]), np.concatenate([found[1][: left.sum()], found[3][: right.sum()]])
        some = links > 0
        return pa.table({"h": hs[some].view(np.int64), "links": links[some], "linked": linked[some]})

    made = dealt.groupBy("choice", "entry", "i", "j").applyInArrow(count, "h BIGINT, links BIGINT, linked BIGINT")
    return made.unionByName(ends).groupBy("h").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))


def _distance(similarity: float) -> int:
    return max(d for d in range(BITS + 1) if 1 - d / BITS >= similarity)


def near_links(rows: DataFrame, key: str, h: str, *, similarity: float = simhash.THRESHOLD, **options) -> DataFrame:
    """A row for each row: key, rep (the least key of its hash), copies, and the links of that class: other hashes so similar, and the rows that have them."""
    # written once, as hashes of whole texts are dear
    stored = scratch.written(rows.select(key, h), f"near-{uuid.uuid4().hex}").withColumn("_h", F.coalesce(h, F.lit(0).cast("bigint")))
    known = classes(stored, key, h)
    # merged, as the sizes of shuffled files, by which Spark would broadcast a side through the driver, are those of packed rows
    found = known.join(link_counts(known, _distance(similarity), **options).hint("merge"), "h", "left")
    none = F.lit(0).cast("bigint")
    own = found.select(F.col("h").alias("_h"), "rep", F.col("n").alias("copies"), F.coalesce("links", none).alias("links"), F.coalesce("linked", none).alias("linked"))
    return stored.join(own.hint("merge"), "_h").select(key, "rep", "copies", "links", "linked")


def near_pairs(rows: DataFrame, key: str, h: str, *, similarity: float = simhash.THRESHOLD, **options) -> DataFrame:
    """Pairs of classes of equal hashes at least so similar: a, b (their representatives, a < b), n_a, n_b, distance. A cluster of near texts has many; `near_links` counts them."""
    known = classes(scratch.written(rows.select(key, h), f"near-{uuid.uuid4().hex}"), key, h)
    found = pairs_within(known.select("h"), _distance(similarity), **options)
    one = known.select("h", F.col("rep").alias("ra"), F.col("n").alias("na"))
    two = known.select(F.col("h").alias("other"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    both = found.join(one.hint("merge"), "h").join(two.hint("merge"), "other")
    swap = F.col("ra") > F.col("rb")
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return both.select(pick("ra", "rb", "a"), pick("rb", "ra", "b"), pick("na", "nb", "n_a"), pick("nb", "na", "n_b"), "distance")
