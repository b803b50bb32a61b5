"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of documents. Its index covers the shard's words that some test
phrase holds; a stretch without such words becomes one separator, since no phrase
can cross it, and stretches shorter than the shortest phrase go as well. Phrases are
searched backwards through the ranks of a wavelet matrix, occurrences are located by
sampled suffix positions, and their word spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, schema_of, small_batches, stash, unpacked

#: Words of a test phrase.
WINDOW = 10
#: Every so many positions of the text a suffix position is kept.
SAMPLE = 8
#: Test words that go to the tasks at once; a larger benchmark is searched in several rounds.
BLOCK_WORDS = 2_000_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return text.translate(_TO_WORDS).split() if text else []


class WaveletMatrix:
    """Ranks in a sequence of symbols below 2**levels, for arrays of queries."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each of its ends."""
        at = [np.zeros_like(symbol), *ends]
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            at = [np.where(bit, zeros + ones[x], x - ones[x]) for x in at]
        return [x - at[0] for x in at[1:]]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols there, and how often each stands before."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
            start = np.where(bit == 1, zeros + ones[start], start - ones[start])
            symbol = symbol * 2 + bit
        return symbol, at - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling. Zeros in the text are separators, each different from all others."""
    n = len(text)
    separators = np.cumsum(text == 0)
    key = np.where(text == 0, separators, text.astype(np.int64) + int(separators[-1]) + 1) if n else text
    step = 1
    while True:
        order = np.argsort(key, kind="stable")
        ranks = np.empty(n, np.int64)
        ranks[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) + 1
        if not n or ranks[order[-1]] == n:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = ranks[step:] if step < n else 0
        key = ranks * (n + 1) + ahead
        step *= 2


class FMIndex:
    """text: symbols from 1, and 0 as separator; the first and the last symbol are separators."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_array(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        # positions after a separator are sampled too: going back from there would cross it
        self.sampled = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array that begin with each phrase (all of one length)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, j]
            a, b = self.wavelet.rank(symbol, lo[live], hi[live])
            lo[live], hi[live] = self.before[symbol] + a, self.before[symbol] + b
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, back = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            symbol, rank = self.wavelet.access(rows[live])
            rows[live] = self.before[symbol] + rank
            back[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.samples[self.at[rows]] + back


class Phrases:
    """Distinct windows of the items, as arrays of symbols grouped by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.ids: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            found = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for i in range(max(1, len(found) - window + 1) if found else 0):
                holders = of.setdefault(tuple(found[i : i + window]), set())
                if item is not None:
                    holders.add(item)
        self.by_length: list[tuple[np.ndarray, list[tuple[str, ...]]]] = []
        for n in sorted({len(p) for p in of}):
            mine = [p for p in of if len(p) == n]
            self.by_length.append((np.array(mine, np.int64), [tuple(of[p]) for p in mine]))
        self.shortest = min((p.shape[1] for p, _ in self.by_length), default=0)


def _search(docs: list[list[bytes]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Merged spans of hit words and the items found, for each document of a shard."""
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    if not phrases.by_length:
        return spans, items
    get = phrases.ids.get
    lengths = np.array([len(d) for d in docs])
    flat = np.array([get(w, 0) for d in docs for w in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), lengths)
    first = np.cumsum(lengths) - lengths
    word = np.arange(len(flat)) - np.repeat(first, lengths)
    # stretches of known words within a document, of at least the shortest phrase
    known = flat > 0
    fresh = known.copy()
    fresh[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(fresh)
    if not len(start):
        return spans, items
    stretch = np.cumsum(fresh) - 1
    size = np.bincount(stretch[known], minlength=len(start))
    kept = np.flatnonzero(known & (size[np.maximum(stretch, 0)] >= phrases.shortest))
    if not len(kept):
        return spans, items
    lead = fresh[kept]
    place = np.arange(len(kept)) + np.cumsum(lead)  # one separator before each stretch
    n = int(place[-1]) + 2
    text, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    text[place], source[place] = flat[kept], kept
    index = FMIndex(text, len(phrases.ids))
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for symbols, holders in phrases.by_length:
        lo, hi = index.search(symbols)
        count = hi - lo
        rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = source[index.locate(rows)]
        hits.append((at, np.full(len(at), symbols.shape[1])))
        for d, p in set(zip(doc[at].tolist(), np.repeat(np.arange(len(count)), count).tolist(), strict=True)):
            items[d].update(holders[p])
    at, width = (np.concatenate(x) for x in zip(*hits, strict=True))
    for i in np.argsort(at, kind="stable"):
        d, a = int(doc[at[i]]), int(word[at[i]])
        b = a + int(width[i])
        if spans[d] and spans[d][-1][1] >= a:
            spans[d][-1] = (spans[d][-1][0], max(b, spans[d][-1][1]))
        else:
            spans[d].append((a, b))
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mapper(phrases, round_one: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases.value
        for batch in batches:
            docs = [words_of(t) for t in batch.column("text").to_pylist()]
            spans, items = _search(docs, known)
            if not round_one:
                spans = [_merged([(s["first"], s["end"]) for s in old] + new) for old, new in zip(batch.column("spans").to_pylist(), spans, strict=True)]
                items = [set(old) | new for old, new in zip(batch.column("items").to_pylist(), items, strict=True)]
            kept = [n for n in batch.schema.names if n not in ("n_words", "spans", "items")]
            out = [batch.column(n) for n in kept] + [
                pa.array([len(d) for d in docs], pa.int64()),
                pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "n_words", "spans", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns `keep` of docs with n_words, spans (of hit words, merged) and items (item_ids found, sorted as strings).

    benchmark: item_id, text. A null or empty text has no words and no phrases; an item with
    a null id marks words but is not listed. Repeated items and documents are each taken as
    they come; either table may be empty. Longer benchmarks than block_words go in
    several rounds over the documents, each with the items of one block. Long texts and long words are taken whole. Kept columns of the new names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    size = items.agg(F.sum("n")).first()[0] or 0
    blocks = 1 + int(size // (6 * block_words))
    rows = packed(docs, keep, F.col(f"`{text}`").cast("binary").alias("text"))
    schema = schema_of(rows, ["__row", "text"], "n_words long, spans array<struct<first:int,end:int>>, items array<string>")
    for b in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        phrases = spark.sparkContext.broadcast(Phrases([(r["id"], bytes(r["text"]) if r["text"] is not None else None) for r in mine.select("id", "text").toLocalIterator()], window))
        rows = rows.mapInArrow(_mapper(phrases, b == 0), schema)
        if b < blocks - 1:
            rows = stash(rows)
    return unpacked(rows, "n_words", "spans", "items")
