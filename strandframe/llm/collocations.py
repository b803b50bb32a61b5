"""Collocations: phrases of two and three words that occur together far oftener than their parts alone.

A task counts in a HAT-trie of word ids: under each first word hangs a hash container of what follows, which bursts into one container for each
second word when it grows. A word is entered once, with the two words after it, for the counts of pairs, of
words and of all words are sums of subtrees. When the trie is full its largest subtrees are spilled whole, as sorted runs. Every entry of
a run belongs to a partition by its language and phrase; there the runs of all tasks merge. One prefix may hold a third of all
entries, therefore a phrase's partition depends on all its words, and the sums of subtrees are entries of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stash
from .text import binary_column

#: A word id has 21 bits, so that three of them pack into one long; 0 is no word.
ID_BITS = 21
MASK = (1 << ID_BITS) - 1
#: Of a second word's id, what a burst container is split by.
DIGIT = 63
#: Entries of a container that make it burst; entries of a task's tries, and words of its dictionary, that make it spill.
BURST, FULL, MOST_WORDS = 1024, 300_000, 200_000
#: Bytes of text for each merging partition, of the whole table.
PARTITION_BYTES = 8 << 20
#: Bytes of text split into words at once.
PIECE = 1 << 20

_STOP = b"\xff"  # in no UTF-8 text
_FOLD = bytes(ord(_STOP) if i in b".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else 32 if i == 9 else i for i in range(256))
_GAP = re.compile(rb"[ \xff]")


class Trie:
    """Counts of (first, second, third) word ids; absent words are 0.

    Under the first word is a container, from packed (second, third) to the count; a large one bursts into containers by a digit of the second word.
    """

    def __init__(self, burst: int = BURST):
        self.root: dict[int, dict] = {}
        self.split: set[int] = set()
        self.sizes: dict[int, int] = {}
        self.entries, self.burst = 0, burst

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct packed keys with their counts."""
        if not len(keys):
            return
        first = keys >> (2 * ID_BITS)
        cut = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]]).tolist()
        words, rest, counts = first[cut[:-1]].tolist(), (keys & ((1 << (2 * ID_BITS)) - 1)).tolist(), counts.tolist()
        for word, a, b in zip(words, cut[:-1], cut[1:], strict=True):
            if word not in self.sizes:
                self.root[word] = dict(zip(rest[a:b], counts[a:b], strict=True))
                self.sizes[word] = 0
                grown = b - a
            elif word in self.split:
                grown, node = 0, self.root[word]
                for key, n in zip(rest[a:b], counts[a:b], strict=True):
                    leaf = node[(key >> ID_BITS) & DIGIT]
                    if key in leaf:
                        leaf[key] += n
                    else:
                        leaf[key] = n
                        grown += 1
            else:
                node = self.root[word]
                grown = -len(node)
                for key, n in zip(rest[a:b], counts[a:b], strict=True):
                    if key in node:
                        node[key] += n
                    else:
                        node[key] = n
                grown += len(node)
            self.entries += grown
            self.sizes[word] += grown
            if word not in self.split and len(self.root[word]) > self.burst:
                leaves: dict[int, dict] = {d: {} for d in range(DIGIT + 1)}
                for key, n in self.root[word].items():
                    leaves[(key >> ID_BITS) & DIGIT][key] = n
                self.root[word] = leaves
                self.split.add(word)

    def take(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Remove whole subtrees, the largest first, until at most `keep` entries are left; their packed keys and counts."""
        words, sizes, rest, counts = [], [], [], []
        for word in sorted(self.sizes, key=lambda w: (-self.sizes[w], w)) if keep else list(self.sizes):
            if self.entries <= keep:
                break
            node = self.root.pop(word)
            for leaf in node.values() if word in self.split else (node,):
                rest.extend(leaf)
                counts.extend(leaf.values())
            words.append(word)
            sizes.append(self.sizes.pop(word))
            self.entries -= sizes[-1]
            self.split.discard(word)
        return np.array(rest, np.int64) + np.repeat(np.array(words, np.int64) << (2 * ID_BITS), np.array(sizes, np.int64)), np.array(counts, np.int64)


class _Words:
    """Ids of the words of a task since its dictionary was emptied."""

    def __init__(self):
        self.ids, self.known, self.hashes = {_STOP: 0}, [b""], [0]

    def of(self, text: bytes) -> np.ndarray:
        """The ids of the words of a text, with a 0 at each stop and at the end."""
        out, a, ids = [], 0, self.ids
        while a < len(text):
            gap = _GAP.search(text, min(len(text), a + PIECE))
            b = gap.end() if gap else len(text)
            found = text[a:b].replace(_STOP, b" \xff ").split()
            fresh = list(set(found).difference(ids))
            ids.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.known += fresh
            self.hashes += map(zlib.crc32, fresh)
            out.append(np.array(list(map(ids.__getitem__, found)), np.int64))
            a = b
        return np.concatenate([*out, [0]]).astype(np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of subtrees: of sorted keys that agree but for the lower bits."""
    head = (keys >> bits) << bits
    at = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
    return head[at], np.add.reduceat(counts, at) if len(at) else counts


def _parts(keys: np.ndarray) -> list[np.ndarray]:
    return [keys >> (2 * ID_BITS), (keys >> ID_BITS) & MASK, keys & MASK]


def _runs(lang: str, keys: np.ndarray, counts: np.ndarray, words: _Words, partitions: int) -> Iterator[pa.RecordBatch]:
    """Subtrees as sorted runs, one for each partition: its phrases, one on a line, and their counts, compressed together."""
    used = np.unique(np.concatenate([[0], *_parts(keys)]))
    text = pa.array([words.known[i] + b" " if i else b"" for i in used.tolist()], pa.binary())
    order = pc.sort_indices(text).to_numpy()  # no word sorts before the absent one
    rank = np.zeros(len(words.known), np.int64)
    rank[used[order]] = np.arange(len(used))
    text, hashes = text.take(pa.array(order)), np.array(words.hashes, np.uint64)[used[order]]
    one, two, three = (rank[p] for p in _parts(keys))
    keys = (one << (2 * ID_BITS)) | (two << ID_BITS) | three
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    full = (keys & MASK) > 0
    pairs, n_pairs = _sums(keys, counts, ID_BITS)
    two = ((pairs >> ID_BITS) & MASK) > 0
    singles, n_singles = _sums(keys, counts, 2 * ID_BITS)
    keys, counts = np.concatenate([[0], singles, pairs[two], keys[full]]), np.concatenate([[counts.sum()], n_singles, n_pairs[two], counts[full]])
    place = sum(hashes[p] * np.uint64(m) for p, m in zip(_parts(keys), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True)) >> np.uint64(20)
    place = (place % np.uint64(partitions)).astype(np.int64)
    by = np.lexsort((keys, place))
    keys, counts, place = keys[by], counts[by], place[by]
    cut = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]]).tolist()
    rows: list[tuple] = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        lines = binary_column(pc.binary_join_element_wise(*(text.take(pa.array(p)) for p in _parts(keys[a:b])), b"\n", b""))[0].tobytes()
        rows.append((int(place[a]), len(lines), b - a, pa.compress(lines + counts[a:b].tobytes(), "zstd", asbytes=True)))
        if len(rows) >= 500 or b == cut[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["lang", "place", "size", "entries", "run"])
            rows = []


def _opened(size: int, entries: int, run: bytes) -> pa.Table:
    whole = pa.decompress(run, size + 8 * entries, "zstd", asbytes=True)
    ends = np.flatnonzero(np.frombuffer(whole, np.uint8, size) == 10) + 1
    lines = pa.Array.from_buffers(pa.binary(), entries, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(whole[:size])])
    return pa.table([lines, pa.array(np.frombuffer(whole[size:], np.int64))], names=["line", "n"])


def _count(partitions: int, full: int, burst: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        words = _Words()

        def spill(keep: int) -> Iterator[pa.RecordBatch]:
            for lang in sorted(tries):
                keys, counts = tries[lang].take(keep)
                if len(keys):
                    yield from _runs(lang, keys, counts, words, partitions)

        for batch in batches:
            texts = batch.column("text")
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(i)
            for lang, rows in by_lang.items():
                trie = tries.setdefault(lang, Trie(burst))
                while rows:
                    held, size = [], 0
                    while rows and size <= PIECE:
                        held.append((texts[rows.pop()].as_py() or b"").translate(_FOLD))
                        size += len(held[-1])
                    ids = words.of(_STOP.join(held))
                    second = np.append(ids[1:], 0)
                    third = np.where(second > 0, np.append(second[1:], 0), 0)
                    keys = (ids << (2 * ID_BITS)) | (second << ID_BITS) | third
                    trie.add(*np.unique(keys[ids > 0], return_counts=True))
                    if len(words.known) > MOST_WORDS:
                        yield from spill(0)
                        words = _Words()
                    elif sum(t.entries for t in tries.values()) > full:
                        yield from spill(full // (2 * len(tries)))
        yield from spill(0)

    return run


def _merge(least: int):
    """Merges the runs of each (lang, place); rows come sorted by these."""

    def merged(key: tuple, runs: list[tuple]) -> pa.RecordBatch:
        n = pa.concat_tables([_opened(*r) for r in runs]).group_by("line", use_threads=False).aggregate([("n", "sum")])
        n = n.filter(pc.or_(pc.greater_equal(n["n_sum"], least), pc.equal(n["line"], b"\n")))
        phrases = [p[:-2].decode() for p in n["line"].to_pylist()]
        words = [p.count(" ") + 1 if p else 0 for p in phrases]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(words, pa.int32()), n["n_sum"].combine_chunks()], names=["lang", "phrase", "words", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_key = None
        for batch in batches:
            for lang, place, *one in zip(*(batch.column(c).to_pylist() for c in ("lang", "place", "size", "entries", "run")), strict=True):
                if held and (lang, place) != held_key:
                    yield merged(held_key, held)
                    held = []
                held.append(one)
                held_key = lang, place
        if held:
            yield merged(held_key, held)

    return run


def phrase_counts(docs: DataFrame, lang: Column, least: int = 10, full: int = FULL, burst: int = BURST, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(text, ...) -> (lang, phrase, words, a): phrases of 1 to 3 words that occur `least` times in a language, and, as the phrase of no words, the number of all words."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    texts = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    runs = texts.mapInArrow(_count(size // partition_bytes + 1, full, burst), "lang string, place long, size long, entries long, run binary")
    return runs.repartition("lang", "place").sortWithinPartitions("lang", "place").mapInArrow(_merge(least), "lang string, phrase string, words int, a long")


def collocations(docs: DataFrame, lang: Column, least: int = 10, share: int = 50, most: int = 2000, **options) -> DataFrame:
    """(text, ...) -> (lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of two or three words.

    A-Z is folded; words are [^\\x20\\x09]+ within pieces that end at . , ; : ! ? and the line ends \\x0A-\\x0D. A phrase has to occur `least` times (a). Of its cuts into two parts, with
    l and r occurrences, the one of least score 10^6 a^2 / (l r) counts, the first of equals; it is an integer, by exact arithmetic. Phrases of two words go if a phrase of three that
    holds them occurs at least `share` percent as often. Ties in score and a go by the bytes of the phrase.
    A null lang is `und`; null and empty texts have no words; repeated rows are counted each; an empty table gives an empty
    result. Long texts and long words are taken whole. Other columns are not looked at.
    """
    counts = stash(phrase_counts(docs, lang, least, **options))
    several = counts.filter("words > 1")
    at = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = several.select("lang", "phrase", "words", "a", at.alias("k")).withColumns({"p1": F.expr("substring_index(phrase, ' ', k)"), "p2": F.expr("substring_index(phrase, ' ', k - words)")})
    parts = counts.filter("words IN (1, 2)")
    left, right = (parts.select(F.col("lang").alias(f"{x}_lang"), F.col("phrase").alias(f"{x}_phrase"), F.col("a").alias(x)) for x in "lr")
    cuts = cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("p1") == F.col("l_phrase"))).join(right, (F.col("lang") == F.col("r_lang")) & (F.col("p2") == F.col("r_phrase")))
    exact = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    score = F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * ({exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    scored = cuts.select("lang", "phrase", "words", "a", "l", "r", "k", score.alias("score"))
    least_cut = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    three = several.filter("words = 3")
    inner = [three.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), F.col("a").alias("longer")) for k in (2, -2)]
    longer = inner[0].unionByName(inner[1]).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = least_cut.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    lots = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(1024))).orderBy(*order)
    first = flat.withColumn("rank", F.row_number().over(lots)).filter(F.col("rank") <= most)  # so no task sorts all phrases of a language
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    total = counts.filter("words = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return ranked.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
