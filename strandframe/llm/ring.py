"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual` points of a ring; a point serves the arc that ends at it.
A row belongs to the arc that its key's hash falls into and would go to that arc's
shard. Each shard has a fixed capacity; what overflows an arc of a full shard goes
on clockwise to the next shards with room. Capacities differ by at most one row and
add up to the number of rows, so the balance is exact, and only overflowing rows
leave the shard that their hash names.

Rows of one arc differ only in their rank, so the walk round the ring needs the
number of rows of each arc and lot, never the rows: a table of `virtual * shards *
lots` counts at most, whatever the input.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_rid

#: The ring has this many places; it bounds the number of arcs.
PLACES = 1 << 16


def arcs(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of each point, in the ring's order. A point's place depends on its shard and number alone."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            place = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % PLACES
            while place in owner:  # another point stands there: the next free place
                place = (place + 1) % PLACES
            owner[place] = shard
    return sorted(owner.items())


def walk(counts: dict[int, int], points: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where each arc's rows go.

    First each shard takes from its own arcs, in the ring's order, up to its
    capacity; then each arc's overflow walks clockwise past the full shards.
    """
    room, taken, out, over = list(capacity), [0] * len(capacity), [], []

    def give(arc: int, lo: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n > 0:
            out.append((arc, lo, lo + n, shard, taken[shard]))
            room[shard] -= n
            taken[shard] += n
        return n

    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        got = give(arc, 0, n, shard)
        if got < n:
            over.append((arc, got, n))
    for arc, lo, n in over:
        step = 1
        while lo < n:
            lo += give(arc, lo, n - lo, points[(arc + step) % len(points)][1])
            step += 1
    return out


def assign(df: DataFrame, key: Column, shards: int, virtual: int = 64, lots: int = 64, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add `shard` (0 .. shards-1) and `slot` (0 .. n-1 within each shard) to every row.

    key: what the ring hashes; equal keys, nulls included, share an arc and spill over
    clockwise together when their shard is full. Repeated rows are rows of their own.
    An empty table gives an empty result. Columns of any name pass through; only
    those named like `shard` and `slot` are replaced. Reruns over the same files agree.
    """
    spark = df.sparkSession
    points = arcs(shards, virtual)
    places = [p for p, _ in points]
    kept = [c for c in df.columns if c not in (shard, slot)]
    place = F.pmod(F.xxhash64(F.lit("ring"), key), F.lit(PLACES)).cast("int")
    rows = with_rid(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), place.alias("__place")), "__rid")
    lookup = spark.createDataFrame([(p, bisect_left(places, p) % len(places)) for p in range(PLACES)], "__place int, __arc int")
    rows = rows.join(F.broadcast(lookup), "__place").withColumn("__lot", F.pmod(F.xxhash64("__rid"), F.lit(lots)).cast("int"))

    found = rows.groupBy("__arc", "__lot").count().collect()  # len(points) * lots rows at most
    per_lot = {(r["__arc"], r["__lot"]): r["count"] for r in found}
    counts, before = {}, []
    for arc in range(len(points)):
        sums = [0, *accumulate(per_lot.get((arc, lot), 0) for lot in range(lots))]
        counts[arc] = sums[-1]
        before += [(arc, lot, sums[lot]) for lot in range(lots) if (arc, lot) in per_lot]
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    moves = walk(counts, points, capacity)

    starts = spark.createDataFrame(before, "__arc int, __lot int, __before long")
    parts = spark.createDataFrame(moves, f"__to int, __lo long, __hi long, `{shard}` int, __slot0 long")
    within = Window.partitionBy("__arc", "__lot").orderBy("__rid")
    ranked = rows.withColumn("__n", F.row_number().over(within)).join(F.broadcast(starts), ["__arc", "__lot"]).withColumn("__rank", F.col("__before") + F.col("__n") - 1)
    placed = ranked.join(F.broadcast(parts), (F.col("__arc") == F.col("__to")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    return placed.select("__row.*", shard, (F.col("__slot0") + F.col("__rank") - F.col("__lo")).alias(slot))
