"""Exact substring dedup: common-prefix intervals of an enhanced suffix array.

Byte strings that occur twice are found without comparing whole texts:

1. Every window of `report` bytes chooses an anchor, its minimizer of `core` bytes; so equal windows
   have equal anchors at equal places. An anchor's context is what any window of
   `length` bytes whose first `report` bytes chose it can hold. Anchors that occur once are done with, and of the
   others only hashes are shuffled: 64 bits of the anchor, and the 128-bit BLAKE2b digest of the context's bytes, which decides whether contexts are equal.
2. Each distinct context of an anchor that has several sends its bytes to the anchor's block.
   There, all suffixes that start at an anchor are sorted with their longest common
   prefixes, and so are the reversed prefixes that end there. A stack scan over the first
   yields the intervals of the common-prefix tree. Within an interval, a second scan over its members' left
   extensions yields those groups that differ both in the byte before and in the byte after what
   they share: the maximal repeats, with all members of each. The bytes in these are the spans.
   A context that occurs several times is a repeat as a whole.
3. Anchors with too many distinct contexts for one task find their maximal repeats by
   aggregations over the depths at which the two sides branch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import discard, small_batches, stash, with_rid
from .minhash import _grouped
from .winnow import stretches

#: Distinct contexts of one anchor that one task holds at once.
BLOCK_CONTEXTS = 20_000
#: Occurrences from which on a context's rows stay where they are and its key is broadcast; so there is one such key for each so many rows at most.
HOT_CONTEXT = 10_000
#: Members of intervals that are looked at together.
MEMBERS = 500_000

_CONTEXT = "m long, s1 long, s2 long, rid long, place int, before int, after int"
_KEY = ["m", "s1", "s2"]


def _anchors(window: int, core: int, left: int, right: int, whole: bool):
    """The anchors of each text, as their hashes `m` only or with the hashes, places and sizes of their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.binary_column(batch.column("text"))
            rid = batch.column("rid").to_numpy()
            for i, j in tx.groups_of_docs(offsets):
                at = int(offsets[i])
                mine = data[at : int(offsets[j])]
                bounds = offsets[i : j + 1] - at
                if len(mine) < window:
                    continue
                sums = tx.prefix_sums(tx.BYTE_VALUES[mine])
                raw = mine.tobytes() if whole else b""

                def grams(a, b, sums=sums):
                    start = np.arange(a, b)
                    return tx.stretch_hashes(sums, start, start + core)

                last = -1
                for _, _, place, m, doc in stretches(grams, len(mine), bounds, window, core):
                    if place[0] == last:  # a piece's first window may have the anchor of the one before it
                        place, m, doc = place[1:], m[1:], doc[1:]
                    if not len(place):
                        continue
                    last = int(place[-1])
                    names, columns = ["m"], [m.view(np.int64)]
                    if whole:
                        before, after = np.minimum(left, place - bounds[doc]), np.minimum(right, bounds[doc + 1] - place)
                        s1, s2 = tx.digests([raw[a:b] for a, b in zip((place - before).tolist(), (place + after).tolist(), strict=True)]).T
                        s1 = tx.mix(s1 + before.astype(np.uint64))  # the anchor's place in it is part of a context
                        names += ["s1", "s2", "rid", "place", "before", "after"]
                        columns += [s1.view(np.int64), s2.view(np.int64), rid[i + doc], *(x.astype(np.int32) for x in (place - bounds[doc], before, after))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each context in `parts`, with its bytes."""
    kinds = {"m": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "rid": pa.int64(), "n": pa.int32(), "place": pa.int32(), "before": pa.int32(), "large": pa.int32(), "bytes": pa.binary()}
    for batch in batches:
        out: dict[str, list] = {n: [] for n in kinds}
        for rid, text, parts in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            for p in parts:
                for n in ("m", "s1", "s2", "n", "place", "before", "large"):
                    out[n].append(p[n])
                out["rid"].append(rid)
                out["bytes"].append(text[p["place"] - p["before"] : p["place"] + p["after"]])
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in out.items()], names=list(out))


def common_prefixes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows (bytes) by group and content, and each row's longest common prefix with the one before it; -1 where a group begins."""
    n, width = rows.shape
    # compared as big-endian words
    words = np.zeros((n, -(-max(width, 1) // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort([*(words[:, c] for c in range(words.shape[1] - 1, -1, -1)), group])
    ahead = rows[order]
    differs = ahead[1:] != ahead[:-1]
    lcp = np.where(differs.any(1), differs.argmax(1), width) if width else np.zeros(n - 1, np.int64)
    lcp = np.concatenate([[-1], np.where(group[order[1:]] == group[order[:-1]], lcp, -1)]).astype(np.int64)
    return order, lcp


def prefix_intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(depth, first, end) of all intervals of the common-prefix tree, by a stack scan."""
    out, stack = [], []
    for i, depth in enumerate([*lcp[1:].tolist(), -1], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            out.append((top, first, i))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def _portions(size: np.ndarray) -> list[np.ndarray]:
    """Indices of items in runs of about `MEMBERS` members."""
    if not len(size):
        return []
    cuts = np.searchsorted(np.cumsum(size), np.arange(MEMBERS, size.sum() + MEMBERS, MEMBERS), "left") + 1
    return [part for part in np.split(np.arange(len(size)), np.unique(cuts[cuts < len(size)])) if len(part)]


class Block:
    """The anchored suffixes and prefixes of some distinct contexts, sorted."""

    def __init__(self, group: np.ndarray, texts: list[bytes], before: np.ndarray, least: int, core: int):
        """before: bytes that stand before each anchor. least: the shortest repeats that count."""
        self.least, self.core, self.before, n = least, core, before, len(texts)
        self.after = np.array([len(t) for t in texts]) - before
        self._minima = None
        # padded by a byte that UTF-8 does not have, which equals none of a text
        self.left, self.right = np.full((n, int(before.max(initial=0))), 255, np.uint8), np.full((n, int(self.after.max(initial=core)) - core), 255, np.uint8)
        for i, t in enumerate(texts):
            raw = np.frombuffer(t, np.uint8)
            b = int(before[i])
            self.left[i, :b] = raw[:b][::-1]
            rest = raw[b + core :]
            self.right[i, : len(rest)] = rest
        self.suffixes, self.lcp = common_prefixes(self.right, group)
        self.prefixes, self.lcs = common_prefixes(self.left, group)

    def _shared_left(self, places: np.ndarray) -> np.ndarray:
        """Common bytes before the anchor of neighbours in a list of growing places in the order of prefixes."""
        lo, hi = places[:-1] + 1, places[1:] + 1
        if self._minima is None:  # least common prefixes of 1, 2, 4, ... neighbours
            self._minima = [self.lcs]
            while 2 << (len(self._minima) - 1) <= len(self.lcs):
                have = self._minima[-1]
                half = 1 << (len(self._minima) - 1)
                self._minima.append(np.minimum(have[:-half], have[half:]))
        level = np.frexp(np.maximum(hi - lo, 1))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero((level == k) & (hi > lo))
            out[at] = np.minimum(self._minima[k][lo[at]], self._minima[k][hi[at] - (1 << k)])
        return out

    def _nodes(self) -> Iterator[tuple[np.ndarray, ...]]:
        """All maximal repeats of at least `least` bytes, as arrays (left, depth, first, end) and the members that first and end refer to.

        Members of an interval of the common-prefix tree share `depth` bytes after the anchor. Their left
        extensions form a tree of their own; each of its intervals, which are diverse in the next byte on the left, whose
        members also differ in the next byte on the right is a maximal repeat, with `left` bytes before the anchor. A context's end differs from everything.
        """
        n = len(self.before)
        place = np.empty(n, np.int64)
        place[self.prefixes] = np.arange(n)
        rest = (self.after - self.core)[self.suffixes]
        lcp = self.lcp.copy()
        lcp[1:] = np.minimum(lcp[1:], np.minimum(rest[1:], rest[:-1]))
        tree = np.array(prefix_intervals(lcp), np.int64).reshape(-1, 3)
        size = tree[:, 2] - tree[:, 1]
        for part in _portions(size):
            depth, first, count = tree[part, 0], tree[part, 1], size[part]
            interval = np.repeat(np.arange(len(part)), count)
            within = np.arange(len(interval)) - np.repeat(np.cumsum(count) - count, count)
            at = first[interval] + within
            child = np.cumsum((lcp[at] == depth[interval]) & (within > 0))
            member = self.suffixes[at]
            order = np.argsort(interval * n + place[member])
            member, child = member[order], child[order]
            shared = np.minimum(self._shared_left(place[member]), np.minimum(self.before[member[1:]], self.before[member[:-1]]))
            shared[(interval[1:] != interval[:-1]) | (shared < self.least - self.core - depth[interval[1:]])] = -1
            nodes = np.array(prefix_intervals(np.concatenate([[-1], shared])), np.int64).reshape(-1, 3)
            changes = np.concatenate([[0], np.cumsum(child[1:] != child[:-1])])
            nodes = nodes[changes[nodes[:, 2] - 1] > changes[nodes[:, 1]]]
            yield nodes[:, 0], depth[interval[nodes[:, 1]]], nodes[:, 1], nodes[:, 2], member

    def reach(self, *lengths: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, how far the maximal repeats of at least that length that hold a context's anchor reach: bytes before its begin and from there on; -1 where there are none."""
        n = len(self.before)
        out = [(np.full(n, -1), np.full(n, -1)) for _ in lengths]
        for left, depth, first, end, member in self._nodes():
            for part in _portions(end - first):
                count = (end - first)[part]
                node = np.repeat(part, count)
                held = member[first[node] + np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)]
                total = left[node] + self.core + depth[node]
                for length, (low, high) in zip(lengths, out, strict=True):
                    long = total >= length
                    np.maximum.at(low, held[long], left[node[long]])
                    np.maximum.at(high, held[long], self.core + depth[node[long]])
        return out

    def maximal_repeats(self) -> list[tuple[int, int, np.ndarray]]:
        """(common bytes before the anchor, common bytes from it on, members) of all maximal repeats of at least `least` bytes."""
        out = []
        for left, depth, first, end, member in self._nodes():
            out += [(e, self.core + d, member[i:j]) for e, d, i, j in zip(left.tolist(), depth.tolist(), first.tolist(), end.tolist(), strict=True)]
        return out


_SPAN = "rid long, begin int, end int, removed boolean"


def _scan(length: int, report: int, core: int, most: int):
    """Spans of the maximal repeats of the contexts of each anchor (rows sorted by m)."""

    def flush(held):
        group = np.repeat(np.arange(len(held)), [len(x["rid"]) for x in held])
        before, place, rid = (np.concatenate([x[k] for x in held]) for k in ("before", "place", "rid"))
        block = Block(group, [t for x in held for t in x["bytes"]], before, report, core)
        spans = []
        for removed, (low, high) in zip((False, True), block.reach(report, length), strict=True):
            at = np.flatnonzero(low >= 0)
            spans.append((rid[at], place[at] - low[at], place[at] + high[at], np.full(len(at), removed)))
        rid, begin, end, removed = (np.concatenate(x) for x in zip(*spans, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(removed)], names=["rid", "begin", "end", "removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, parts in _grouped(batches, "m"):
            one = {k: np.concatenate([p.column(k).to_numpy() for p in parts]) for k in ("rid", "place", "before")}
            one["bytes"] = [b for p in parts for b in p.column("bytes").to_pylist()]
            held.append(one)
            n += len(one["rid"])
            if n >= most:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _clean(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs, sums, left, again = [], [], [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, spans = text or b"", spans or ()
                gone = _merged([(x["begin"], x["end"]) for x in spans if x["removed"]])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                whole = b"".join(kept)
                n.append(len(text))
                removed.append(len(text) - len(whole))
                runs.append(len(gone))
                sums.append(hashlib.sha256(whole).hexdigest())
                left.append(whole)
                again.append(sum(b - a for a, b in _merged([(x["begin"], x["end"]) for x in spans])))
            columns = {"n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sums, pa.string()), "n_repeated": pa.array(again, pa.int64()), "kept": pa.array(left, pa.binary())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(columns[k] for k in keep)], names=["doc_id", *keep])

    return run


def _contexts(docs: DataFrame, window: int, core: int, right: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rid, text) -> all contexts of repeated anchors; the distinct ones with their number (2 for more), and where one stands;
    and those of them whose anchor has several, with their bytes and whether it has over `block` (`large`). A context with `HOT_CONTEXT` occurrences is `hot`."""
    small_batches(docs.sparkSession)
    texts = docs.select("rid", "text")
    again = stash(texts.mapInArrow(_anchors(window, core, window - core, right, False), "m long").groupBy("m").agg(F.count("*").alias("k")).filter("k > 1").select("m"))
    # the join shuffles both sides anew, so Spark can split a hot anchor
    found = stash(texts.mapInArrow(_anchors(window, core, window - core, right, True), _CONTEXT).join(again, "m"))
    discard(again)
    n = F.least(F.count("*"), F.lit(2)).cast("int").alias("n")
    hot = (F.count("*") >= HOT_CONTEXT).alias("hot")
    distinct = stash(found.groupBy(*_KEY).agg(n, hot, F.min(F.struct("rid", "place", "before", "after")).alias("one")).select(*_KEY, "n", "hot", "one.*"))
    several = stash(distinct.groupBy("m").agg(F.count("*").alias("distinct")).filter("distinct > 1"))
    parts = distinct.join(several, "m").select("rid", F.struct(*_KEY, "n", "place", "before", "after", (F.col("distinct") > block).cast("int").alias("large")).alias("part"))
    parts = parts.groupBy("rid").agg(F.collect_list("part").alias("parts"))
    rows = stash(docs.join(parts, "rid").select("rid", "text", "parts").mapInArrow(_cut, "m long, s1 long, s2 long, rid long, n int, place int, before int, large int, bytes binary"))
    discard(several)
    return found, distinct, rows


def _equal_contexts(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """The rows of `found` whose context occurs several times. Those of a hot one would all be in one task of a join that shuffles them."""
    hot = F.broadcast(distinct.filter("hot").select(*_KEY))
    others = found.join(hot, _KEY, "left_anti").join(distinct.filter("n > 1 AND NOT hot").select(*_KEY), _KEY)
    return found.join(hot, _KEY).unionByName(others)


def dedup_substrings(docs: DataFrame, length: int = 400, report: int | None = None, core: int | None = None, keep: tuple = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), block: int = BLOCK_CONTEXTS) -> DataFrame:
    """(doc_id, text) -> doc_id and the columns `keep` of: n_bytes, n_removed, n_spans, kept_sha256, n_repeated, kept (the remaining bytes).

    Removes each byte that a `length`-byte string covers which also starts anywhere else in the
    UTF-8 bytes of the texts, the same document included; strings never cross
    documents. n_repeated counts the bytes that such strings of `report` bytes (by default `length`) cover, whether they
    are removed or not. Null texts are empty. Repeated rows are rows of their own, and so repeat
    each other; texts shorter than `length` stay. An empty table gives an empty result. Extra columns are not looked at.
    """
    report = report or length
    core = core or report // 2
    docs = with_rid(docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")))
    found, distinct, rows = _contexts(docs, report, core, length, block)
    span = lambda begin, end: [begin.alias("begin"), end.alias("end"), (end - begin >= length).alias("removed")]
    equal = _equal_contexts(found, distinct).select("rid", *span(F.col("place") - F.col("before"), F.col("place") + F.col("after")))
    near = rows.filter("large = 0").select("m", "rid", "place", "before", "bytes").repartition("m").sortWithinPartitions("m").mapInArrow(_scan(length, report, core, BLOCK_CONTEXTS), _SPAN)
    large = rows.filter("large = 1")
    begin = F.col("place") - F.col("left")
    frequent = _frequent_repeats(large, report, core).join(large.select(*_KEY, "rid", "place"), _KEY).select("rid", *span(begin, begin + F.col("n_bytes")))

    per_doc = equal.unionByName(near).unionByName(frequent).groupBy("rid").agg(F.collect_list(F.struct("begin", "end", "removed")).alias("spans"))
    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "n_repeated": "long", "kept": "binary"}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {kinds[k]}" for k in keep)
    return docs.join(per_doc, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_clean(list(keep)), schema)


#: Rows of depths or pairs in one Arrow batch.
_ROWS = 50_000


def _joined(parts: list[dict[str, np.ndarray | list]], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(p[k], t) for p in parts]) for k, t in kinds.items()], names=list(kinds))


def _prefix_digests(first: bytes, rest: bytes) -> np.ndarray:
    """Digests of first, of first and one byte of rest, and so on."""
    at, out = hashlib.blake2b(first, digest_size=8), []
    out.append(at.digest())
    for i in range(len(rest)):
        at.update(rest[i : i + 1])
        out.append(at.digest())
    return np.frombuffer(b"".join(out), np.int64)


def _depths(core: int):
    """For each number of bytes before (side 0) and after (side 1) the anchor: its hash, and the next byte as least and largest."""
    kinds = {"m": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "side": pa.int32(), "depth": pa.int32(), "h": pa.int64(), "low": pa.int32(), "high": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for m, s1, s2, b, t in zip(*(batch.column(c).to_pylist() for c in ("m", "s1", "s2", "before", "bytes")), strict=True):
                left, middle, right = t[:b][::-1], t[b : b + core], t[b + core :]
                e, d = np.arange(len(left) + 1), np.arange(len(right) + 1)
                after = [np.frombuffer(x, np.uint8).astype(np.int32) for x in (left, right)]  # a context's end differs from everything
                low, high = (np.concatenate([after[0], [x], after[1], [x]]) for x in (-1, 256))
                h = np.concatenate([_prefix_digests(middle, left), _prefix_digests(middle, right)])
                n = len(h)
                held.append({"m": np.full(n, m), "s1": np.full(n, s1), "s2": np.full(n, s2), "side": np.repeat([0, 1], [len(e), len(d)]), "depth": np.concatenate([e, d]), "h": h, "low": low, "high": high})
                rows += n
                if rows >= _ROWS:
                    yield _joined(held, kinds)
                    held, rows = [], 0
        if held:
            yield _joined(held, kinds)

    return run


def _pairs(least: int, core: int):
    """For each pair of depths at which a context's two sides branch: the name of the bytes between, and the next bytes."""
    kinds = {"repeat": pa.string(), "m": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "n": pa.int32(), "left": pa.int32(), "n_bytes": pa.int32()} | dict.fromkeys(("l0", "l1", "r0", "r1"), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {k: [] for k in kinds}
        for batch in batches:
            for m, s1, s2, n, b, t, lefts, rights in zip(*(batch.column(c).to_pylist() for c in ("m", "s1", "s2", "n", "before", "bytes", "lefts", "rights")), strict=True):
                end = len(t)
                for left in {*lefts, b}:
                    for right in {*rights, end - b - core}:
                        if left + core + right >= least:
                            i, j = b - left, b + core + right
                            before, after = (t[i - 1],) * 2 if i else (-1, 256), (t[j],) * 2 if j < end else (-1, 256)
                            row = (hashlib.sha256(t[i:j]).hexdigest(), m, s1, s2, n, left, j - i, *before, *after)
                            for k, x in zip(kinds, row, strict=True):
                                held[k].append(x)
                if len(held["m"]) >= _ROWS:
                    yield _joined([held], kinds)
                    held = {k: [] for k in kinds}
        if held["m"]:
            yield _joined([held], kinds)

    return run


def _frequent_repeats(rows: DataFrame, least: int, core: int) -> DataFrame:
    """Maximal repeats of anchors with too many distinct contexts for a block, by aggregations only.

    The two ends of a maximal repeat are branching nodes of the trees of all bytes before and after its
    anchor. These come from an aggregation over each depth; then a second one, over the pairs of a context's branching depths.
    """
    depths = stash(rows.mapInArrow(_depths(core), "m long, s1 long, s2 long, side int, depth int, h long, low int, high int"))
    branching = depths.groupBy("m", "side", "depth", "h").agg(F.count("*").alias("k"), F.min("low").alias("low"), F.max("high").alias("high")).filter("k > 1 AND low <> high").select("m", "side", "depth", "h")
    mine = depths.join(stash(branching), ["m", "side", "depth", "h"])
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("depth")))
    mine = mine.groupBy(*_KEY).agg(of(0).alias("lefts"), of(1).alias("rights"))
    pairs = stash(rows.join(mine, _KEY).mapInArrow(_pairs(least, core), "repeat string, m long, s1 long, s2 long, n int, left int, n_bytes int, l0 int, l1 int, r0 int, r1 int"))
    key = ["m", "repeat", "left", "n_bytes"]
    ends = [f(c).alias(c) for c, f in (("l0", F.min), ("l1", F.max), ("r0", F.min), ("r1", F.max))]
    diverse = pairs.groupBy(*key).agg(F.sum("n").alias("k"), *ends).filter("k > 1 AND l0 <> l1 AND r0 <> r1").select(*key)
    return pairs.join(stash(diverse), key).select("repeat", "n_bytes", *_KEY, "left")


def repeat_groups(docs: DataFrame, length: int = 400, core: int | None = None, block: int = BLOCK_CONTEXTS) -> DataFrame:
    """(doc_id, text) -> maximal repeats of at least `length` bytes: (repeat, n_bytes, doc_id, begin), one row for each occurrence.

    repeat is the SHA-256 of the repeated bytes. Intervals are found among the distinct contexts
    of an anchor and their occurrences joined from all texts. A repeat longer than a context is
    reported by each anchor in it, with the part that its contexts show. Anchors with over `block` distinct
    contexts go through aggregations instead of a block. Null texts are empty; an empty table gives an empty result.
    """
    core = core or length // 2
    docs = with_rid(docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")))
    found, distinct, rows = _contexts(docs, length, core, length, block)

    def run(batches):
        for m, got in _grouped(batches, "m"):
            s1, s2, before = (np.concatenate([p.column(k).to_numpy() for p in got]) for k in ("s1", "s2", "before"))
            texts = [b for p in got for b in p.column("bytes").to_pylist()]
            for left, right, members in Block(np.zeros(len(texts), np.int64), texts, before, length, core).maximal_repeats():
                i, k = int(members[0]), len(members)
                name = hashlib.sha256(texts[i][before[i] - left : before[i] + right]).hexdigest()
                yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array([left + right] * k, pa.int32()), pa.array(np.full(k, m)), pa.array(s1[members]), pa.array(s2[members]), pa.array([left] * k, pa.int32())], names=["repeat", "n_bytes", *_KEY, "left"])

    def named(batches):
        for batch in batches:
            names = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                names += [{**p, "repeat": hashlib.sha256(text[p["place"] - p["before"] : p["place"] + p["after"]]).hexdigest()} for p in places]
            kinds = {"repeat": pa.string(), "m": pa.int64(), "s1": pa.int64(), "s2": pa.int64()}
            columns = [pa.array([x["repeat"] for x in names], pa.string()), pa.array([x["before"] + x["after"] for x in names], pa.int32()), *(pa.array([x[k] for x in names], kinds[k]) for k in _KEY), pa.array([x["before"] for x in names], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["repeat", "n_bytes", *_KEY, "left"])

    kind = "repeat string, n_bytes int, m long, s1 long, s2 long, left int"
    near = rows.filter("large = 0").repartition("m").sortWithinPartitions("m").mapInArrow(run, kind)
    copies = distinct.filter("n > 1").groupBy("rid").agg(F.collect_list(F.struct(*_KEY, "place", "before", "after")).alias("places"))
    whole = docs.join(copies, "rid").select("text", "places").mapInArrow(named, kind)
    each = near.unionByName(whole).unionByName(_frequent_repeats(rows.filter("large = 1"), length, core))
    at = each.join(found.select(*_KEY, "rid", "place"), _KEY).select("repeat", "n_bytes", "rid", (F.col("place") - F.col("left")).alias("begin"))
    return at.join(docs.select("rid", "doc_id"), "rid").select("repeat", "n_bytes", "doc_id", "begin").distinct()
