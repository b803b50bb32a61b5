"""Thinning a table: k-means with many starts for common rows, density clusters for outliers.

All starts of k-means advance together: one aggregation an iteration holds the sums of every cluster of every start. Density clusters with one
point as the least are the components of the graph of points at most a radius apart. Points of one small cell of a grid in all dimensions are joined without a look at their pairs; what
is left is cut along its widest axis, with a margin of the radius on one side, until a task can compare a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .stats import spread_labels

#: Rows that the starts are drawn from: those of least hash. All rows count in every iteration.
SEED_ROWS = 10_000
#: Rows compared with centres or with each other at once.
BLOCK_ROWS = 1024
#: Points that one task compares with each other.
PART = 4000


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, from products; the nearest of near ones are exact to about 1e-15 of the squares."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with a probability in proportion to its squared distance from those before it."""
    chosen = [int(rng.integers(len(sample)))]
    far = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < k:
        weight = far if far.sum() > 0 else np.ones(len(sample))
        chosen.append(int(rng.choice(len(sample), p=weight / weight.sum())))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _step(centres: np.ndarray):
    """For each cluster of each start (rows of centres: start, cluster): its number of rows, their sum and squared distances."""
    starts, k, width = centres.shape
    flat = centres.reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, sums = np.zeros(starts * k), np.zeros(starts * k), np.zeros((starts * k, width))
        for batch in batches:
            every = _matrix(batch.column("v"))
            for i in range(0, len(every), BLOCK_ROWS):
                x = every[i : i + BLOCK_ROWS]
                d = distances(x, flat).reshape(len(x), starts, k)
                mine = d.argmin(2) + np.arange(starts) * k
                member = np.zeros((starts * k, len(x)))
                member[mine.T.ravel(), np.tile(np.arange(len(x)), starts)] = 1
                n += member.sum(1)
                sums += member @ x
                cost += np.bincount(mine.ravel(), d.min(2).ravel(), starts * k)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (width + 2), pa.int32()), pa.array(np.column_stack([n, cost, sums])[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists], names=["c", "s"])

    return run


def k_means(rows: DataFrame, k: int, starts: int = 100, most: int = 500, seed: int = 1) -> tuple[np.ndarray, float]:
    """(id, v) -> the centres of the best of `starts` runs of up to `most` iterations, and their squared distances' sum.

    A run ends when its centres stand still; a cluster without rows keeps its centre. Fewer distinct rows than k give as many clusters as have rows.
    """
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SEED_ROWS).select("v").collect()])
    rng = np.random.default_rng(seed)
    centres = np.stack([first_centres(sample, k, rng) for _ in range(starts)])
    best = np.full(starts, np.inf)
    moving = np.arange(starts)
    for _ in range(most):
        now = centres[moving]
        found = rows.select("v").mapInArrow(_step(now), "c int, s array<double>").groupBy("c").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect()
        fresh, cost = now.reshape(-1, now.shape[2]).copy(), np.zeros(len(moving))
        for r in found:
            n, c, *total = r["s"]
            cost[r["c"] // k] += c
            fresh[r["c"]] = np.array(total) / n
        fresh = fresh.reshape(now.shape)
        best[moving] = cost  # of the centres before this move
        still = np.abs(fresh - now).max((1, 2)) <= 1e-12
        centres[moving] = fresh
        moving = moving[~still]
        if not len(moving):
            break
    i = int(best.argmin())
    return centres[i], float(best[i])


def nearest_rows(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v) -> (cluster, id): of the rows whose nearest centre is a cluster's, the one nearest to it, of equals the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            d = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=["id", "cluster", "d"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, cluster int, d double").groupBy("cluster").agg(F.min_by("id", F.struct("d", "id")).alias("id"))


def _forest(radius: float):
    """Links that join the points of each part like all pairs at most `radius` apart (rows sorted by part). Points with one `root` are joined already."""

    def links(x: np.ndarray, root: np.ndarray, ids: list) -> Iterator[tuple]:
        label = np.unique(root, return_inverse=True)[1]
        for i in range(0, len(x), BLOCK_ROWS):
            d = distances(x[i : i + BLOCK_ROWS], x)
            size = (x * x).sum(1)
            slack = 1e-12 * (size[i : i + BLOCK_ROWS, None] + size[None] + 1)
            for a, b in zip(*np.nonzero((d <= radius**2 + slack) & (label[i : i + BLOCK_ROWS, None] != label[None])), strict=True):
                if label[i + a] != label[b] and ((x[i + a] - x[b]) ** 2).sum() <= radius**2:
                    yield ids[i + a], ids[b]
                    label[label == label[b]] = label[i + a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids = table["id"].to_pylist()
            found = list(links(_matrix(table["v"].combine_chunks()), np.array(table["root"].to_pylist()), ids))
            kind = table.schema.field("id").type
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], kind), pa.array([b for _, b in found], kind)], names=["a", "b"])

        for batch in batches:
            keys = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and keys[a] != part:
                    yield flush()
                    held = []
                held.append(batch.slice(a, b - a))
                part = keys[a]
        if held:
            yield flush()

    return run


def density_labels(points: DataFrame, radius: float, most: int = PART) -> DataFrame:
    """(id, v) -> (id, label): the least id of each density cluster, in any number of dimensions."""
    width = points.select(F.max(F.size("v"))).first()[0] or 1
    side = max(radius, 1e-300) / math.sqrt(width) * (1 - 1e-9)
    cell = F.transform("v", lambda x: F.floor(x / side))
    roots = written(points.groupBy(cell.alias("cell")).agg(F.min("id").alias("root")))
    open_parts = written(points.withColumn("cell", cell).join(roots, "cell").select(F.lit(0).cast("long").alias("part"), "id", "v", "root"))
    rooted, done = open_parts.select("id", "root"), []
    while True:
        sizes = written(open_parts.groupBy("part").agg(F.count("*").alias("n")))
        small = open_parts.join(sizes.filter(F.col("n") <= most).select("part"), "part", "left_semi")
        done.append(small)
        large = open_parts.join(sizes.filter(F.col("n") > most), "part")
        if sizes.filter(F.col("n") > most).isEmpty():
            break
        axes = large.select("part", F.posexplode("v").alias("axis", "x")).groupBy("part", "axis").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", F.lit(0.5), F.lit(1000)).alias("middle"))
        widest = axes.groupBy("part").agg(F.max_by(F.struct("axis", "low", "high", "middle"), F.struct(F.col("high") - F.col("low"), -F.col("axis"))).alias("w"))
        split = large.join(widest, "part").withColumn("x", F.get("v", F.col("w.axis")))
        lower, upper = F.col("x") <= F.col("w.middle") + radius, F.col("x") > F.col("w.middle")
        shares = split.groupBy("part").agg(F.avg(lower.cast("double")).alias("share"))
        split = written(split.join(shares, "part").select("part", "id", "v", "root", "n", lower.alias("lower"), upper.alias("upper"), ((F.col("share") <= 0.75) & (F.col("w.middle") < F.col("w.high"))).alias("cuts")))
        sides = F.array_compact(F.array(F.when(F.col("lower"), F.lit(0)), F.when(F.col("upper"), F.lit(1))))
        # a part that no cut makes much smaller is compared as pairs of blocks
        blocks = F.ceil(2 * F.col("n") / most)
        mine = F.pmod(F.xxhash64("id"), blocks)
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.concat_ws("-", F.least(mine, other).cast("string"), F.greatest(mine, other).cast("string")))
        tight = split.filter("NOT cuts").select("part", "id", "v", "root", F.explode(pairs).alias("pair")).select(F.xxhash64("part", "pair").alias("part"), "id", "v", "root")
        done.append(tight)
        open_parts = written(split.filter("cuts").select("part", "id", "v", "root", F.explode(sides).alias("half")).select(F.xxhash64("part", "half").alias("part"), "id", "v", "root"))
    parts = done[0]
    for more in done[1:]:
        parts = parts.unionByName(more)
    kind = points.schema["id"].dataType.simpleString()
    found = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_forest(radius), f"a {kind}, b {kind}")
    links = written(found.unionByName(rooted.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))))
    return spread_labels(points.select("id"), links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def density_representatives(points: DataFrame, radius: float, most: int = PART) -> DataFrame:
    """(id, v) -> (id): of each density cluster the row nearest to its mean."""
    members = points.join(density_labels(points, radius, most), "id")
    means = members.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"))
    return members.join(means, "label").groupBy("label").agg(F.min_by("id", F.struct(_squared(F.col("v"), F.col("m")), F.col("id"))).alias("id")).select("id")


def standardised(df: DataFrame, row_id: str, values: Column) -> DataFrame:
    """(id, v): the values as deviations from their means in population deviations; columns of one value become 0. Rows that lack a value have no part."""
    rows = df.select(F.col(row_id).alias("id"), values.alias("v")).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    at = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("v")).alias("s")).select("s.*").first()
    n = at["count"]
    if not n:
        return rows
    mean = F.array(*[F.lit(float(x)) for x in at["mean"].toArray()])
    spread = np.sqrt(at["variance"].toArray() * (n - 1) / n) if n > 1 else np.zeros(len(at["mean"]))
    scale = F.array(*[F.lit(float(1 / s) if s > 0 else 0.0) for s in spread])
    return rows.select("id", F.zip_with(F.zip_with("v", mean, lambda x, m: x - m), scale, lambda x, s: x * s).alias("v"))


def undersample(df: DataFrame, features: list[str], row_id: str, k: int = 8, starts: int = 100, most: int = 500, whisker: float = 1.5, radius: float = 0.6, part: int = PART) -> dict[str, DataFrame]:
    """Common rows and outliers, each thinned: rows nearest to k-means centres, and rows nearest to the means of density clusters.

    features: names of scalar or vector columns. A row is an outlier if any value lies more than `whisker` quartile ranges beyond its column's quartiles.
    Clusters of outliers link rows within `radius` times the root of the common rows' mean squared distance from their centres. Both sides are
    standardised by themselves. Results: common, outliers (the split) and common_kept, outliers_kept.
    """
    from .collinear import matrix_columns
    from .quantiles import quantiles

    values, names = matrix_columns(df, features)
    each = df.select(F.posexplode(values).alias("i", "x"))
    quartiles = {r["i"]: (r["q"][0], r["q"][1]) for r in quantiles(each, ["i"], ["x"], [0.25, 0.75]).collect()}
    low, high = (F.array(*[F.lit(float(f(*quartiles[i]))) for i in range(len(names))]) for f in (lambda a, b: a - whisker * (b - a), lambda a, b: b + whisker * (b - a)))
    x = values
    far = F.exists(F.zip_with(F.zip_with(x, low, lambda v, a: v < a), F.zip_with(x, high, lambda v, b: v > b), lambda a, b: a | b), lambda y: y)
    flagged = written(df.withColumn("__far", F.coalesce(far, F.lit(False))))
    common, rare = (flagged.filter(c).drop("__far") for c in ("NOT __far", "__far"))
    z = written(standardised(common, row_id, values))
    n = z.count()
    if n:
        centres, cost = k_means(z, min(k, n), starts, most)
        near = nearest_rows(z, centres).select(F.col("id").alias(row_id))
    else:
        cost, near = 0.0, common.select(row_id)
    kept = density_representatives(written(standardised(rare, row_id, values)), radius * math.sqrt(cost / max(n, 1)), part).select(F.col("id").alias(row_id))
    return {"common": common, "outliers": rare, "common_kept": common.join(near, row_id, "left_semi"), "outliers_kept": rare.join(kept, row_id, "left_semi")}
