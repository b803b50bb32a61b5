"""Long repeated word spans by compaction of a De Bruijn graph.

Nodes of the graph are `window` - 1 words in a row, edges are windows of `window` words, which join the nodes at their ends.

1. Edges are dealt out by their minimizers. Edges in a row with one minimizer are compacted as they are read, into a `path` with its source
   coordinates; only minimizers that two documents hold go on. Where all paths of a minimizer are equal, no node inside branches and no path begins or ends
   inside another one: the path is a repeat as a whole.
2. Of other minimizers, the paths at their first source coordinates are opened into edges again. Aggregations give the
   first document of each edge and the in- and out-degree of each node over the distinct edges. Joins bring these to
   the edges' coordinates, and repeated edges that follow each other there across a node of in- and out-degree one compact into one span.
3. All occurrences of a path meet its first one by a join on the 128-bit BLAKE2b digest of the words that stand at their source
   coordinates (of an edge, on 64 bits of it besides its two nodes); spans then are cut out of the texts at these coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import discard, small_batches, stash, with_rid
from .winnow import stretches

#: Words of the minimizers.
CORE = 5
SEED = np.uint64(0x5851F42D4C957F2D)


def _grams(words: np.ndarray, k: int):
    sums = tx.word_prefix_sums(words ^ SEED)

    def at(a: int, b: int) -> np.ndarray:
        start = np.arange(a, b)
        return tx.word_stretch_hashes(sums, start, start + k)

    return at


def _at_places(texts: list[bytes], doc: np.ndarray, first: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Digests of the words first..end-1 of documents, in rising order of these; whatever stands between the words."""
    out, cut = [], np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    for text, a, b in zip(texts, cut[:-1], cut[1:], strict=True):
        if b > a:
            whole, begins, ends = tx.spelled(text)
            out.append(tx.digests([whole[x:y] for x, y in zip(begins[first[a:b]].tolist(), ends[end[a:b] - 1].tolist(), strict=True)], size))
    return np.concatenate(out).view(np.int64) if out else np.zeros((0, size // 8), np.int64)


def _paths(window: int, core: int, whole: bool):
    """The compacted paths of each text: minimizer and document only, or with the hashes of their words and their coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.binary_column(batch.column("text"))
            rid, doc_id = batch.column("rid").to_numpy(), batch.column("doc_id")
            for i, j in tx.groups_of_docs(offsets):
                words, bounds = tx.words(data, offsets[i : j + 1], tx.BYTE_VALUES)
                if len(words) < window:
                    continue
                texts = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)] if whole else []
                for first, last, _, m, doc in stretches(_grams(words, core), len(words), bounds, window, core):
                    columns = {"m": pa.array(m.view(np.int64)), "doc_id": doc_id.take(pa.array(i + doc))}
                    if whole:
                        p = _at_places(texts, doc, first - bounds[doc], last + window - bounds[doc], 16)
                        columns |= {"p1": pa.array(p[:, 0]), "p2": pa.array(p[:, 1]), "rid": pa.array(rid[i + doc]), "first": pa.array((first - bounds[doc]).astype(np.int32)), "n": pa.array((last - first + 1).astype(np.int32))}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _edges(window: int):
    """The edges of the paths `places` of each text, with the nodes u and v at their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.binary_column(batch.column("text"))
            places, doc_ids, rids = batch.column("places").to_pylist(), batch.column("doc_id"), batch.column("rid").to_numpy()
            for i, j in tx.groups_of_docs(offsets):
                words, bounds = tx.words(data, offsets[i : j + 1], tx.BYTE_VALUES)
                sums = tx.word_prefix_sums(words)
                texts = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                first, n = (np.array([p[k] for d in places[i:j] for p in d], np.int64) for k in ("first", "n"))
                doc = np.repeat(np.repeat(np.arange(i, j), [len(d) for d in places[i:j]]), n)
                begin = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = bounds[doc - i] + begin
                u, v = (tx.word_stretch_hashes(sums, start + k, start + k + window - 1).view(np.int64) for k in (0, 1))
                e = _at_places(texts, doc - i, begin, begin + window, 8)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(e), pa.array(rids[doc]), doc_ids.take(pa.array(doc)), pa.array(begin.astype(np.int32))], names=["u", "v", "e", "rid", "doc_id", "first"])

    return run


def _clean(window: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sums, left, spans = [], [], [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                words = text.split() if text else []
                merged: list[list[int]] = []
                for a, b in sorted((p["first"], p["first"] + p["n"] + window - 1) for p in places or ()):
                    if merged and merged[-1][1] >= a:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                whole = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                sums.append(hashlib.sha256(whole).hexdigest())
                left.append(whole)
                spans.append([{"first": a, "end": b} for a, b in merged])
            columns = {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sums, pa.string()), "kept": pa.array(left, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(columns[k] for k in keep)], names=["doc_id", *keep])

    return run


def compacted(edges: DataFrame) -> DataFrame:
    """(u, v, e, rid, doc_id, first), edges at coordinates -> (rid, first, n): runs of edges that a smaller doc_id holds too.

    Edges are equal if u, v and e are. An edge and the next one at its coordinates compact if both have the same first
    document and the node between them has one edge in and one out; all others begin a run of their own.
    """
    distinct = stash(edges.groupBy("u", "v", "e").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2")))
    ends = distinct.select(F.col("u").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")).unionByName(distinct.select(F.col("v").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")))
    inner = stash(ends.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out")).filter("into = 1 AND out = 1").select("node"))
    known = distinct.filter("d1 < d2").join(inner, F.col("u") == F.col("node"), "left").select("u", "v", "e", "d1", F.col("node").isNotNull().alias("inner"))
    known = stash(known)  # the join then shuffles both sides anew, and Spark can split a hot edge
    later = edges.join(known, ["u", "v", "e"]).filter("doc_id > d1").select("rid", "first", "d1", "inner")
    in_text = Window.partitionBy("rid").orderBy("first")
    goes_on = F.col("inner") & (F.lag("first").over(in_text) == F.col("first") - 1) & (F.lag("d1").over(in_text) == F.col("d1"))
    runs = later.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("begins").over(in_text))
    runs = stash(runs.groupBy("rid", "run").agg(F.min("first").alias("first"), F.count("*").cast("int").alias("n")).select("rid", "first", "n"))
    discard(distinct, inner, known)
    return runs


def dedup_spans(docs: DataFrame, window: int = 13, core: int = CORE, keep: tuple = ("n_words", "n_removed", "kept_sha256")) -> DataFrame:
    """(doc_id, text) -> doc_id and the columns `keep` of: n_words, n_removed, kept_sha256, kept (words joined by a space), spans (removed words).

    Removes each word [^\\x20\\x09-\\x0D]+ that a window of `window` words covers whose words
    also start in a document of smaller doc_id. Null texts have no words, shorter texts no
    windows. A null doc_id is neither smaller nor larger than others: its row keeps all
    words and is no reason to remove any. Rows with one doc_id leave each other alone.
    An empty table gives an empty result. Extra columns are not looked at.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = with_rid(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    texts = docs.filter("doc_id is not null").select("rid", "doc_id", "text")
    # minimizers that more than one document holds; written first, so that the join shuffles both sides anew and Spark can split a hot one
    shared = stash(texts.mapInArrow(_paths(window, core, False), f"m long, doc_id {kind}").groupBy("m").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2")).filter("d1 < d2").select("m"))
    met = texts.mapInArrow(_paths(window, core, True), f"m long, doc_id {kind}, p1 long, p2 long, rid long, first int, n int").join(shared, "m")
    met = stash(met)
    discard(shared)
    paths = stash(met.groupBy("m", "p1", "p2").agg(F.min("doc_id").alias("p_first")))
    alone = stash(paths.groupBy("m").agg(F.count("*").alias("paths")).filter("paths = 1").select("m", F.lit(True).alias("alone")))
    of_paths = stash(paths.join(alone, "m", "left").select("m", "p1", "p2", "p_first", F.coalesce("alone", F.lit(False)).alias("alone")))
    held = stash(met.join(of_paths, ["m", "p1", "p2"]).select("rid", "doc_id", "first", "n", "p_first", "alone"))
    discard(met, paths, alone, of_paths)
    copies = held.filter("doc_id > p_first").select("rid", "first", "n")
    opened = held.filter("doc_id = p_first AND NOT alone").groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("places"))
    edges = stash(docs.join(opened, "rid").select("rid", "doc_id", "text", "places").mapInArrow(_edges(window), f"u long, v long, e long, rid long, doc_id {kind}, first int"))
    later = compacted(edges)
    discard(edges)

    places = copies.unionByName(later).groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("places"))
    kinds = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept": "binary", "spans": "array<struct<first:int,end:int>>"}
    schema = f"doc_id {kind}, " + ", ".join(f"{k} {kinds[k]}" for k in keep)
    return docs.join(places, "rid", "left").select("doc_id", "text", "places").mapInArrow(_clean(window, list(keep)), schema)
