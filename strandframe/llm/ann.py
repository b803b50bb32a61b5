"""Approximate nearest neighbours by shifted space-filling curves.

Each vector gets a key on several Hilbert curves: its direction is projected on a few random axes,
shifted, and cut into a grid. In each ordering the vectors are ranked by a range partitioning, and
a query meets those in a window of ranks around its own, a fixed share of the table on either
side. Ranks are cut into blocks of bounded size; a query visits the blocks of its window, keeps the
best there by exact cosine, and the blocks' and orderings' results merge.

A tight group puts more vectors on one key than a window holds. Those of such a key are ordered by a
finer key within it, that of their residuals from the group's mean in cells of the group's own size,
and so on; what still ties then is searched whole. Equal keys are in an order that is random in each ordering.

Positive multiples of a vector have its direction and go on as one, with the few least ids that any answer can name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .minhash import _grouped

#: Orderings, projected axes and bits an axis (50 bits a key).
ORDERINGS, AXES, CELL_BITS = 16, 10, 5
#: Share of the distinct vectors in a window on either side, and the least number of them. Isotropic vectors
#: have no near neighbourhood that a curve could keep together, so recall needs a share, not a number.
SHARE, LEAST = 0.032, 64
#: Keys that a vector gets in an ordering, each within the one before.
LEVELS = 4
#: Vectors that a task compares at once.
BLOCK = 1024
#: Queries compared with a block at once.
QUERIES = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with `bits`-bit coordinates (rows), by reflecting and exchanging axes level by level."""
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for axis in range(axes):
            upper = (x[axis] & high) != 0
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[axis] ^= swap
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[axes - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            out = (out << 1) | ((x[axis] >> level) & 1)
    return out


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _axes(width: int, axes: int, seed: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Projected axes and shifts of an ordering."""
    rng = np.random.default_rng([seed, t])
    axis, _ = np.linalg.qr(rng.normal(size=(width, min(axes, width))))
    return axis, rng.random(axis.shape[1])


def _directions(column) -> np.ndarray:
    v = _vectors(column)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cells(spread: np.ndarray, bits: int) -> np.ndarray:
    return np.clip(spread * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def _keys(orderings: int, axes: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _directions(batch.column("v"))
            for t in range(orderings):
                axis, shift = _axes(v.shape[1], axes, seed, t)
                cells = _cells((v @ axis) * np.sqrt(v.shape[1]) / 8 + 0.25 + 0.5 * shift, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(hilbert_keys(cells, bits)), batch.column("node")], names=["t", "key", "node"])

    return run


def _project(axes: int, seed: int):
    """The coordinates x of each row on the axes of its ordering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, t = _directions(batch.column("v")), batch.column("t").to_numpy()
            x = np.zeros((len(v), min(axes, v.shape[1])))
            for one in np.unique(t).tolist():
                x[t == one] = v[t == one] @ _axes(v.shape[1], axes, seed, one)[0]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("key"), batch.column("node"), flat], names=["t", "key", "node", "x"])

    return run


def _finer(groups: dict, axes: int, bits: int, seed: int):
    """The key of each row within its group. groups: mean and deviation of x by ordering and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, t = _vectors(batch.column("x")), batch.column("t").to_numpy()
            mine = [groups[g] for g in zip(t.tolist(), map(tuple, batch.column("key").to_pylist()), strict=True)]
            mean, deviation = (np.array(m) for m in zip(*mine, strict=True))
            size = deviation.max(1, keepdims=True)  # one for all axes, which keeps angles
            shift = np.array([np.random.default_rng([seed, one, 1]).random(x.shape[1]) for one in range(int(t.max()) + 1)])
            spread = (x - mean) / np.where(size > 0, 8 * size, 1) + 0.25 + 0.5 * shift[t]
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("key"), batch.column("node"), pa.array(hilbert_keys(_cells(spread, bits), bits))], names=["t", "key", "node", "finer"])

    return run


def _dense(keys: DataFrame, window: int) -> DataFrame:
    """(t, key, size) of the keys with more vectors than a window; at most 1 / share of them in an ordering."""
    return stash(keys.groupBy("t", "key").agg(F.count("*").alias("size")).filter(F.col("size") > window).coalesce(1))


def _refine(keys: DataFrame, dense: DataFrame, nodes: DataFrame, axes: int, bits: int, seed: int) -> DataFrame:
    """Keys with one more level for the vectors of dense ones."""
    inside = keys.join(F.broadcast(dense.select("t", "key")), ["t", "key"]).join(nodes.select("node", "v"), "node").select("t", "key", "node", "v")
    inside = stash(inside.mapInArrow(_project(axes, seed), "t int, key array<long>, node long, x array<double>"))
    places = range(inside.select(F.size("x")).first()[0])
    sizes = inside.groupBy("t", "key").agg(F.array(*[F.avg(F.col("x")[i]) for i in places]).alias("mean"), F.array(*[F.stddev_pop(F.col("x")[i]) for i in places]).alias("deviation"))
    groups = {(r["t"], tuple(r["key"])): (r["mean"], r["deviation"]) for r in sizes.collect()}
    finer = inside.mapInArrow(_finer(groups, axes, bits, seed), "t int, key array<long>, node long, finer long").select("t", F.array_append("key", F.col("finer")).alias("key"), "node")
    return stash(keys.join(F.broadcast(dense.select("t", "key")), ["t", "key"], "left_anti").unionByName(finer))


def _search(k: int):
    """Rows sorted by block, its vectors (kind 0) before its queries (kind 1): the k best of each block for each query."""

    def best(q_node, q, c_node, c, c_norm):
        q_norm = np.sqrt((q * q).sum(1))
        rough = (q @ c.T) / np.outer(q_norm, c_norm)
        bar = np.partition(rough, max(0, len(c_node) - k), axis=1)[:, max(0, len(c_node) - k)] - 1e-9
        row, col = np.nonzero(rough >= bar[:, None])
        score = (q[row] * c[col]).sum(1) / (q_norm[row] * c_norm[col])
        order = np.lexsort([c_node[col], -score, row])
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, np.arange(len(q_node)))
        kept = np.arange(len(row)) - first[row] < k
        return pa.RecordBatch.from_arrays([pa.array(q_node[row[kept]]), pa.array(c_node[col[kept]]), pa.array(score[kept])], names=["q", "c", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, nodes, vectors, c = None, [], [], None
        for batch in batches:
            for g, parts in _grouped(iter([batch]), "gid"):
                if g != gid:
                    gid, nodes, vectors, c = g, [], [], None
                part = parts[0]
                kind, node, v = part.column("kind").to_numpy(), part.column("node").to_numpy(), _vectors(part.column("v"))
                if (kind == 0).any():
                    nodes.append(node[kind == 0])
                    vectors.append(v[kind == 0])
                if not (kind == 1).any():
                    continue
                if c is None:
                    c_node, c = np.concatenate(nodes), np.concatenate(vectors)
                    c_norm = np.sqrt((c * c).sum(1))
                q_node, q = node[kind == 1], v[kind == 1]
                for i in range(0, len(q), QUERIES):
                    yield best(q_node[i : i + QUERIES], q[i : i + QUERIES], c_node, c, c_norm)

    return run


def nearest(vectors: DataFrame, queries, k: int = 5, orderings: int = ORDERINGS, share: float = SHARE, least: int = LEAST, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k nearest by cosine of each row that meets the condition `queries`.

    A row is no neighbour of its own; ties go to the smaller vec_id. Null ids and vectors that are null, zero, or
    hold null or non-finite components take no part. Vectors of different lengths are no neighbours: those of each length are searched by themselves. Rows
    with equal vec_id and direction count once. A table of fewer rows gives what there is, an empty one
    an empty result. Other columns are not looked at.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).filter("n > 1").orderBy("width").collect()
    found = [_nearest(rows.filter(F.size("v") == r["width"]), queries, k, orderings, share, least, block, seed) for r in widths]
    return reduce(DataFrame.unionByName, found) if found else rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)


def _nearest(rows: DataFrame, queries, k: int, orderings: int, share: float, least: int, block: int, seed: int) -> DataFrame:
    """Neighbours among vectors of one length."""
    # distinct directions: the least id names it; k + 1 ids are enough for any query's answer. Division is rounded
    # correctly, so that exact multiples become bit-equal. Scores come from the vector of the least id, scaled by a power of two, which loses no bit
    most = F.array(F.array_max(F.transform("v", F.abs)))  # bound by a lambda, which computes it once for each row
    even = F.transform(most, lambda m: F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(m)))))[0]
    rows = rows.select("vec_id", even.alias("original"), F.transform(most, lambda m: F.transform("v", lambda x: x / m))[0].alias("v"))
    ids = rows.groupBy("v", "vec_id").agg(F.min("original").alias("original")).withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("i") <= k + 1)
    nodes = stash(ids.groupBy("v").agg(F.min("vec_id").alias("node"), F.min_by("original", "vec_id").alias("original"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = stash(rows.filter(queries).select("vec_id", "v").distinct().join(nodes.select("v", "node"), "v").select("vec_id", "node"))

    n = nodes.count()
    window = max(least, int(np.ceil(share * n)))
    keys = nodes.select("node", "v").mapInArrow(_keys(orderings, AXES, CELL_BITS, seed), "t int, key long, node long")
    keys = stash(keys.select("t", F.array("key").alias("key"), "node"))
    dense = _dense(keys, window)
    for _ in range(LEVELS - 1):
        if dense.isEmpty():
            break
        keys = _refine(keys, dense, nodes, AXES, CELL_BITS, seed)
        dense = _dense(keys, window)
    order = ["t", "key", "tie", "node"]
    ranked = keys.withColumn("tie", F.xxhash64("node", "t"))
    ranked = stash(ranked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("part", F.shiftright("place", 33))
    parts = ranked.groupBy("t", "part").agg(F.min("place").alias("lowest"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("t"), F.col("part"), "lowest", before.alias("before"))
    ranked = ranked.join(parts, ["t", "part"]).select("t", "key", "node", (F.col("before") + F.col("place") - F.col("lowest")).alias("rank"))
    gid = lambda b: F.col("t").cast("long") * (1 << 40) + b
    held = ranked.select(gid(F.floor(F.col("rank") / block)).alias("gid"), F.lit(0).alias("kind"), "node")
    low, high = F.greatest(F.lit(0), F.col("rank") - window), F.least(F.lit(max(n - 1, 0)), F.col("rank") + window)
    sent = ranked.join(asked.select("node").distinct(), "node", "left_semi")
    if not dense.isEmpty():  # keys that still tie are searched whole
        ties = ranked.join(F.broadcast(dense), ["t", "key"]).groupBy("t", "key").agg(F.min("rank").alias("lowest"), F.max("rank").alias("highest"))
        sent = sent.join(F.broadcast(ties), ["t", "key"], "left")
        low, high = F.least(low, "lowest"), F.greatest(high, "highest")
    reach = F.sequence(F.floor(low / block), F.floor(high / block))
    sent = sent.select("t", "node", F.explode(reach).alias("b")).select(gid(F.col("b")).alias("gid"), F.lit(1).alias("kind"), "node")
    work = held.unionByName(sent).join(nodes.select("node", F.col("original").alias("v")), "node").select("gid", "kind", "node", "v")
    found = work.repartition("gid").sortWithinPartitions("gid", "kind").mapInArrow(_search(k + 1), "q long, c long, score double")
    merged = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    top = merged.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("i") <= k + 1)
    named = top.join(nodes.select(F.col("node").alias("c"), "ids"), "c").groupBy("q").agg(F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("far"), x.alias("vec_id"))))).alias("near"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(named, "q")
    best = F.slice(F.sort_array(F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))), 1, k)
    return own.select("query_id", F.posexplode(best).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
