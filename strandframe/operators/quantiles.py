"""Exact quantiles of groups of any size: by ranks in one range partitioning, so that no group's values meet in one task or buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and each row's place in its group there (from 1); rows come sorted by group (h, g)."""
    part, last, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g = (batch.column(c).to_numpy() for c in ("h", "g"))
        fresh = np.concatenate([[last != (h[0], g[0])], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        row = np.arange(1, len(h) + 1)
        begin = np.maximum.accumulate(np.where(fresh, row - 1, -1))
        place = np.where(begin >= 0, row - begin, row + at)
        last, at = (h[-1], g[-1]), int(place[-1])
        kept = [n for n in batch.schema.names if n not in ("h", "g")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(np.full(len(h), part, np.int32)), pa.array(place)], names=[*kept, "part", "place"])


def quantiles(df: DataFrame, key: list[str], features: list[str], qs: list[float]) -> DataFrame:
    """(key, feature, q): for each group and feature the quantiles `qs`, linear between neighbours; groups without a value of a feature have no row.

    All values are dealt to ranges of (group, value), each range counts its rows of a group, and the counts of the ranges before give
    every row its rank. A group that holds most of the rows is many ranges. Null values have no part; a null in the key is a group.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("v")) for f in features])
    rows = df.select(F.struct(F.lit(0).alias("__0"), *[F.col(f"`{k}`") for k in key]).alias("k"), F.explode(pairs).alias("x")).select("k", "x.*").filter(F.col("v").isNotNull())
    rows = rows.select("*", F.xxhash64("k", "feature").alias("h"), F.hash("k", "feature").alias("g"))
    order = ["h", "g", "v"]
    kind = rows.schema["k"].dataType.simpleString()
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_positions, f"k {kind}, feature string, v double, part int, place long"))
    ranges = placed.groupBy("k", "feature", "part").agg(F.max("place").alias("n"))
    group = Window.partitionBy("k", "feature")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("*", before.alias("before"), (F.sum("n").over(group) - 1).alias("last"))
    at = [F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), F.least(F.floor(F.col("last") * F.lit(float(q))) + up, F.col("last")).alias("rank")) for i, q in enumerate(qs) for up in (0, 1)]
    wanted = ranges.select("k", "feature", "part", "before", "n", "last", F.explode(F.array(*at)).alias("w")).filter((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("n")))
    wanted = wanted.select("k", "feature", "part", (F.col("w.rank") - F.col("before") + 1).alias("place"), "last", "w.i", "w.up")
    found = placed.join(wanted, ["k", "feature", "part", "place"]).groupBy("k", "feature").agg(
        *[F.max(F.when((F.col("i") == i) & (F.col("up") == up), F.col("v"))).alias(f"v{i}_{up}") for i in range(len(qs)) for up in (0, 1)], F.first("last").alias("last")
    )
    share = lambda q: F.col("last") * F.lit(float(q)) - F.floor(F.col("last") * F.lit(float(q)))
    values = [F.col(f"v{i}_0") + share(q) * (F.col(f"v{i}_1") - F.col(f"v{i}_0")) for i, q in enumerate(qs)]
    return found.select(*[F.col(f"k.`{k}`") for k in key], "feature", F.array(*values).alias("q"))
