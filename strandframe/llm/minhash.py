"""Near-duplicate documents by b-bit MinHash.

Each document's distinct word shingles give 128 minima. Groups of four minima are band
keys; documents that share one are candidates. Of each minimum the lowest two bits are
packed into a 256-bit signature, and candidates are compared by bit counts, corrected
for chance agreement of two-bit values. What passes a generous limit is confirmed on
the full shingle sets, in which words are compared as they are, not by hashes.

Neither step emits all pairs: within a group it is enough to know a spanning forest of
the links. A task compares pivots with the whole group until every member outside the
largest component has been a pivot; then no link between components can be left.
Larger groups go in pieces that share a few pivots. Most near copies are then joined across
the pieces, and only members outside the group's largest component still meet all others: a link
between two components has an end outside the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import small_batches, stash, with_rid
from .components import components

BANDS, ROWS, BITS = 32, 4, 2
MINIMA = BANDS * ROWS
#: Candidates with at least this estimate are confirmed on their full sets. A pair at similarity 0.8 has 0.85 of the 2-bit values in
#: common: 19.2 of 128 differ, with a standard deviation of 4.04. Here 40 may, five deviations more.
LEAST_ESTIMATE = 0.58
#: Members of a candidate group, and shingles of a verification group, in one piece, and at most in one task.
PIECE_ROWS, GROUP_ROWS = 250, 50_000
PIECE_SHINGLES, GROUP_SHINGLES = 100_000, 4_000_000
#: Members of a large group that each of its pieces holds.
PIVOTS = 4

_rng = np.random.default_rng(77)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_ODD = np.uint64(0x5555555555555555)


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of an Arrow binary column."""
    data, offsets = tx.binary_column(column)
    for i, j in tx.groups_of_docs(offsets):
        words, first = tx.words(data, offsets[i : j + 1], tx.FOLDED_VALUES)
        sums = tx.word_prefix_sums(words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = b - a
            if not n:
                yield np.zeros(0, np.uint64)
                continue
            start = np.arange(a, a + max(1, n - width + 1))
            yield np.unique(tx.word_stretch_hashes(sums, start, start + min(width, n)))


def exact_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as numbers that are equal for equal words only (within this list)."""
    ids: dict[bytes, int] = {}
    rows, at = [], [0]
    for text in texts:
        words = np.array([ids.setdefault(w, len(ids) + 1) for w in (text or b"").lower().split()], np.int64)  # bytes.lower folds A-Z only
        if 0 < len(words) < width:
            words = np.concatenate([words, np.zeros(width - len(words), np.int64)])  # 0 is no word
        rows.append(np.lib.stride_tricks.sliding_window_view(words, width) if len(words) else np.zeros((0, width), np.int64))
        at.append(at[-1] + len(rows[-1]))
    shingles = np.concatenate(rows)
    bits, code, most = len(ids).bit_length(), np.zeros(len(shingles), np.int64), 0
    for c in range(width):
        if most + bits > 62:  # number what is there so far
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            most = len(code).bit_length()
        code, most = (code << bits) | shingles[:, c], most + bits
    return [np.unique(code[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 512):
        part = shingles[i : i + 512, None] * _A + _B
        np.minimum(out, (part ^ (part >> np.uint64(29))).min(0), out=out)
    return out


def signature(minimum: np.ndarray) -> np.ndarray:
    """The lowest two bits of the minima, 32 to a word."""
    low = tx.mix(minimum) & np.uint64((1 << BITS) - 1)
    return (low.reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)


def different(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many of the two-bit values each signature differs from one."""
    x = one ^ others
    return np.bitwise_count((x | (x >> np.uint64(1))) & _ODD).sum(-1)


def estimate(n_different) -> np.ndarray:
    """Similarity from differing two-bit values: a chance agreement has probability 1/4."""
    chance = 0.5**BITS
    return np.maximum(0.0, (1 - np.asarray(n_different) / MINIMA - chance) / (1 - chance))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, keys, sigs = [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                ids.append(tx.digests([s.tobytes()])[0])
                m = minima(s)
                bands = tx.mix(m.reshape(BANDS, ROWS) * np.array([1, 3, 5, 7], np.uint64) + np.uint64(11)).sum(1, dtype=np.uint64)
                keys.append(tx.mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                sigs.append(signature(m).tobytes())
            rows = len(n)
            ids = np.array(ids, np.uint64).reshape(-1, 2).view(np.int64)
            keys = pa.array((np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(n, pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), keys), pa.array(sigs, pa.binary())],
                names=["rid", "n_shingles", "set1", "set2", "bands", "sig"],
            )

    return run


def spanning_forest(label: np.ndarray, links) -> list[tuple[int, int]]:
    """Links that join the members of a group like all its links. links(i): which members are linked with i.

    label: a component, below the number of members, for each; members of one are joined already. The largest component is
    compared only as far as needed: once every member outside it was a pivot, no link
    between components is unknown.
    """
    label, done, out = label.copy(), np.zeros(len(label), bool), []
    while True:
        left = np.flatnonzero((label != np.bincount(label).argmax()) & ~done)
        if not len(left):
            return out
        pivot = int(left[0])
        done[pivot] = True
        found = np.flatnonzero(links(pivot))
        new, at = np.unique(label[found], return_index=True)
        for other, i in zip(new.tolist(), found[at].tolist(), strict=True):
            if other != label[pivot]:
                out.append((pivot, i))
        joined = np.append(new, label[pivot])
        label[np.isin(label, joined)] = joined.min()


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != held_key:
                yield held_key, held
                held = []
            held.append(batch.slice(a, b - a))
            held_key = keys[a]
    if held:
        yield held_key, held


def _members(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and component labels of a group."""
    node, root = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("node", "root"))
    return node, np.unique(root, return_inverse=True)[1]


def _links_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each candidate group under the estimated similarity."""
    a, b = [], []
    for _, parts in _grouped(batches, "gid"):
        node, label = _members(parts)
        if len(node) > 1:
            sig = np.frombuffer(b"".join(x for p in parts for x in p.column("sig").to_pylist()), np.uint64).reshape(len(node), -1)
            for i, j in spanning_forest(label, lambda i, sig=sig: estimate(different(sig[i], sig)) >= LEAST_ESTIMATE):
                a.append(int(node[i]))
                b.append(int(node[j]))
        if len(a) >= 10_000:
            yield _links_batch(a, b)
            a, b = [], []
    yield _links_batch(a, b)


def _confirmed(width: int, num: int, den: int):
    """A spanning forest of each group under the exact similarity |x&y| / |x|y| >= num/den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, parts in _grouped(batches, "gid"):
            node, label = _members(parts)
            sets = exact_sets([t for p in parts for t in p.column("text").to_pylist()], width)
            size = np.array([len(s) for s in sets])
            edges = np.cumsum(size) - size
            values, token = np.unique(np.concatenate(sets), return_inverse=True)

            def linked(i, token=token, edges=edges, size=size, n=len(values)):
                mine = np.zeros(n, bool)
                mine[token[edges[i] : edges[i] + size[i]]] = True
                common = np.add.reduceat(mine[token], edges, dtype=np.int64)
                return den * common >= num * (size + size[i] - common)

            for i, j in spanning_forest(label, linked):
                a.append(int(node[i]))
                b.append(int(node[j]))
            if len(a) >= 10_000:
                yield _links_batch(a, b)
                a, b = [], []
        yield _links_batch(a, b)

    return run


def grouped_components(members: DataFrame, piece: int, most: int, scan) -> DataFrame:
    """(key, node, weight, ...) -> (node, root): components of the links that scan finds among the members of each key.

    scan takes (gid, node, root, ...) rows, at most about two `most` of weight in each gid, and returns (a, b) links that join each gid's
    members as all their links do, given that members of equal root are joined. A key of more than `piece` goes in pieces
    with common pivots; then its members outside its largest component meet all of its members, in blocks no smaller
    than they are together, so that the rows stay within twice the key's until that exceeds `most`.
    """
    others = [c for c in members.columns if c not in ("key", "node", "weight")]
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pieces = stash(members.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).filter("n > 1").select("key", F.ceil(F.col("w") / min(piece, most)).alias("pieces")))
    rows = members.join(pieces, "key")
    first = rows.withColumn("at", place("pieces"))
    as_groups = lambda df, *key: df.select(F.xxhash64(*key).alias("gid"), "node", F.col("root" if "root" in df.columns else "node").alias("root"), *others)
    if pieces.filter("pieces > 1").isEmpty():
        return components(scan(as_groups(first, "key", "at")))
    large = stash(rows.filter("pieces > 1"))
    picks = large.groupBy("key", "pieces").agg(F.array_distinct(F.array(*[F.min_by(F.struct("node", *others), F.xxhash64("node", F.lit(i))) for i in range(PIVOTS)])).alias("pivots"))
    pivots = picks.select("key", "pieces", F.inline("pivots")).withColumn("at", each("pieces")).filter(F.col("at") != place("pieces"))
    known = stash(components(scan(as_groups(first, "key", "at").unionByName(as_groups(pivots, "key", "at")))))

    rooted = stash(large.drop("pieces").join(known, "node", "left").withColumn("root", F.coalesce("root", "node")))
    shares = rooted.groupBy("key", "root").agg(F.sum("weight").alias("w"))
    open_keys = shares.groupBy("key").agg(F.max(F.struct("w", "root")).alias("main"), F.sum("w").alias("w")).select("key", F.col("main.root").alias("main"), "w", (F.col("w") - F.col("main.w")).alias("outside")).filter("outside > 0")
    block = F.least(F.greatest(F.col("outside"), F.lit(min(piece, most))), F.lit(most))
    meet = rooted.join(stash(open_keys.select("key", "main", F.ceil(F.col("w") / block).alias("blocks"), F.ceil(F.col("outside") / most).alias("sides"))), "key")
    every = meet.withColumns({"at": place("blocks")}).withColumn("side", each("sides"))
    outside = meet.filter("root <> main").withColumns({"side": place("sides")}).withColumn("at", each("blocks")).filter(F.col("at") != place("blocks"))
    links = scan(as_groups(every, "key", "at", "side").unionByName(as_groups(outside, "key", "at", "side")))
    return components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def near_duplicates(docs: DataFrame, width: int, num: int = 80, den: int = 100, piece_rows: int = PIECE_ROWS, group_rows: int = GROUP_ROWS, piece_shingles: int = PIECE_SHINGLES, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(rid, text) -> (rid, n_shingles, root): root is one rid for all documents that links connect.

    rid: unique longs. Documents are linked if their sets of `width`-word shingles
    (ASCII letters folded; a shorter text is one shingle) have at least num/den of their union
    in common. Null texts and texts without words have an empty set and no link.
    Equal sets, such as those of exact copies, go on as one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("rid", F.col("text").cast("binary").alias("text"))
    sketches = stash(rows.mapInArrow(_sketches(width), "rid long, n_shingles long, set1 long, set2 long, bands array<long>, sig binary"))
    full = sketches.filter("n_shingles > 0")
    # aggregates are written before they are joined on their own keys: both sides are then shuffled anew, and Spark can split a hot key
    classes = stash(full.groupBy("set1", "set2", "n_shingles").agg(F.min("rid").alias("node")))
    members = stash(full.select("rid", "set1", "set2", "n_shingles").join(classes, ["set1", "set2", "n_shingles"]).select("rid", "node", "n_shingles"))
    nodes = members.filter("rid = node").select("node", "n_shingles")

    keyed = sketches.join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.explode("bands").alias("key"), F.col("rid").alias("node"), F.lit(1).alias("weight"), "sig")
    candidates = stash(grouped_components(keyed, piece_rows, group_rows, lambda groups: groups.repartition("gid").sortWithinPartitions("gid").mapInArrow(_estimated, "a long, b long")))

    near = stash(rows.join(candidates.select(F.col("node").alias("rid")), "rid", "left_semi"))  # all texts are shuffled once, however often groups are compared

    def confirm(groups: DataFrame) -> DataFrame:
        texts = near.join(groups, F.col("rid") == F.col("node")).select("gid", "node", "root", "text")
        return texts.repartition("gid").sortWithinPartitions("gid").mapInArrow(_confirmed(width, num, den), "a long, b long")

    sized = candidates.join(nodes, "node").select(F.col("root").alias("key"), "node", F.col("n_shingles").alias("weight"))
    found = grouped_components(sized, piece_shingles, group_shingles, confirm)

    roots = members.join(found, "node", "left").select("rid", F.coalesce("root", "node").alias("root"))
    return sketches.select("rid", "n_shingles").join(roots, "rid", "left").select("rid", "n_shingles", F.coalesce("root", "rid").alias("root"))


def label_components(docs: DataFrame, width: int, **options) -> DataFrame:
    """Add n_shingles, component_id (the smallest doc_id linked, directly or not) and `first` (whether the row is the one to keep).

    A null doc_id is larger than all others; of rows with equal doc_id one is first. All columns pass through, but
    those of the three names are replaced. Repeated rows are rows of their own; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("n_shingles", "component_id", "first")]
    rows = with_rid(docs, "__rid")
    found = near_duplicates(rows.select(F.col("__rid").alias("rid"), "text"), width, **options)
    ids = stash(rows.select(F.col("__rid").alias("rid"), "doc_id").join(found, "rid"))
    best = stash(ids.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")))
    labels = ids.join(best, F.col("root") == F.col("r")).select(F.col("rid").alias("__rid"), F.struct("n_shingles", "component_id", (F.col("rid") == F.col("best.rid")).alias("first")).alias("__label"))
    return rows.join(labels, "__rid").select(*[F.col(f"`{c}`") for c in kept], "__label.*")
