"""Alignment of two tokenizers' tokens of the same text, by products of sparse matrices.

The tokens of each vocabulary are the rows of a token-byte incidence matrix in CSR form. The row product A B' (Gustavson's: each row of A
adds up rows of B') links tokens that overlap. Where the last link of one A token and the first of the next have
no B token in common, both vocabularies end a token: there groups are cut. The product of the group incidence
matrices then links all tokens that share a group.

Neither tokenizer joins anything across a single space between two visible characters, or from a letter to a stop, so a text is a sequence of units, and a
task aligns each distinct unit once. How many documents hold a pair of ids linked is a Spark aggregation over all documents.
The commonest pairs, up to a bound, go to the tasks as sorted arrays; the counts of all others come by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, packed, schema_of, small_batches, stash, unpacked, with_rid

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids whose counts are broadcast (17 bytes each).
HEAD = 1 << 20
#: Characters of text that are aligned at once, and what the units that a task remembers may hold: characters, of units up to a length, and links.
PIECE, MOST_CHARS, LONGEST, MOST_LINKS = 1 << 19, 1 << 22, 64, 1_500_000
#: Bytes of units that are encoded as one text.
TOGETHER = 1 << 14
#: Products that a block of rows may add up.
BLOCK = 1 << 21

_UNITS = re.compile(r"(?<=\S) (?=\S)")
_STOPS = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁ])(?=[.,;:!?])")  # these ranges hold letters only
#: Begins a unit that goes on from a letter without a space. Texts that hold it are one unit, in a tuple.
_ON = "\0"


def _goes_on(unit) -> bool:
    return isinstance(unit, str) and unit[0] == _ON


class Csr:
    """A sparse matrix: row i has columns[start[i]:start[i+1]] with these values."""

    def __init__(self, start: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.start, self.columns, self.values, self.width = start, columns, values, width

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> Csr:
        """From entries in any order; equal places add up."""
        key, place = np.unique(rows * shape[1] + columns, return_inverse=True)
        total = np.bincount(place, values, len(key)).astype(np.int64)
        start = np.searchsorted(key, np.arange(shape[0] + 1) * shape[1])
        return cls(start, key % max(shape[1], 1), total, shape[1])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def transposed(self) -> Csr:
        by = np.argsort(self.columns, kind="stable")
        start = np.searchsorted(self.columns[by], np.arange(self.width + 1))
        return Csr(start, self.rows()[by], self.values[by], len(self.start) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """a b by rows: row i is the sum of b's rows k times a[i, k]. Blocks of rows bound what is added up at once."""
    size = np.concatenate([[0], np.cumsum(np.diff(b.start)[a.columns])])  # products up to each entry of a
    n, out, i = len(a.start) - 1, [], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(size[a.start], size[a.start[i]] + BLOCK, "right")) - 1)
        mine = slice(a.start[i], a.start[j])
        each = np.diff(b.start)[a.columns[mine]]
        at = np.repeat(b.start[a.columns[mine]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        rows = np.repeat(np.repeat(np.arange(j - i), np.diff(a.start[i : j + 1])), each)
        out.append(Csr.of(rows, b.columns[at], np.repeat(a.values[mine], each) * b.values[at], (j - i, b.width)))
        i = j
    if not out:
        return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), b.width)
    shift = np.cumsum([0, *(len(x.columns) for x in out)])
    start = np.concatenate([*(x.start[:-1] + s for x, s in zip(out, shift[:-1], strict=True)), shift[-1:]])
    return Csr(start, np.concatenate([x.columns for x in out]), np.concatenate([x.values for x in out]), b.width)


class Tokenizers:
    """Both vocabularies, with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            rules = json.load(f)
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary writes as themselves; the others follow from 256 on
        others = [i for i in range(256) if i not in set(plain)]
        byte_of = {chr(c): b for b, c in chain(((b, b) for b in plain), ((b, 256 + k) for k, b in enumerate(others)))}
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        split = rules.get("pre_tokenizer") or {}
        #: Whether texts may be cut at single spaces: no token of either vocabulary then goes on after one.
        self.cuts = rules.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not any("▁" in p.lstrip("▁") for p in pieces)
        self.cuts &= not any(_STOPS.search(p) for p in pieces) and self.b.encode("a  b") == self.b.encode("a  b c")[: len(self.b.encode("a  b"))]
        self.letter = tuple(len(x[0]) for x in self.encode(["a"]))
        self.widths = tuple(np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def units(self, text: str) -> list:
        if not text:
            return []
        if not self.cuts or _ON in text:
            return [(text,)]
        return _UNITS.split(_STOPS.sub(" " + _ON, text))

    def one_by_one(self, units: list) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """For either vocabulary the ids of all units and their number in each, and whether they spell it. What goes on from a letter is encoded after one, whose tokens are cut off."""
        on = [_goes_on(u) for u in units]
        a, b = self.encode(["a" + u[1:] if o else u if isinstance(u, str) else u[0] for u, o in zip(units, on, strict=True)])
        a, b = ([x[k:] if o else x for x, o in zip(ids, on, strict=True)] for ids, k in zip((a, b), self.letter, strict=True))
        spelled = [(u[1:] if o else " " + u if isinstance(u, str) else " " + u[0]).encode() for u, o in zip(units, on, strict=True)]
        ok = [b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == u for u, x, y in zip(spelled, a, b, strict=True)]
        out = []
        for ids in (a, b):
            kept = [x if o else [] for x, o in zip(ids, ok, strict=True)]
            out.append((np.fromiter(chain.from_iterable(kept), np.int64), np.array([len(x) for x in kept], np.int64), np.array(ok, bool)))
        return out

    def together(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for units that begin and end visibly, which are encoded as texts of many units; these are cut where the units end."""
        on = np.array([_goes_on(u) for u in units], bool)
        texts = ["a" + u[1:] if o else u for u, o in zip(units, on.tolist(), strict=True)]
        size = np.array([len(t.encode()) + 1 for t in texts], np.int64)
        cut = np.searchsorted(np.cumsum(size) // TOGETHER, np.arange(size.sum() // TOGETHER + 2))
        parts = [slice(i, j) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if j > i]
        joined = [" ".join(texts[p]) for p in parts]
        found: list[list] = [[], []]
        for p, text, *both in zip(parts, joined, *self.encode(joined), strict=True):
            ends, raw, mine = np.cumsum(size[p]), (" " + text).encode(), []
            for ids, of, width, letter in zip(both, (self.a_bytes, self.b_bytes), self.widths, self.letter, strict=True):
                ids = np.array(ids, np.int64)
                at = np.searchsorted(np.cumsum(width[ids]), ends) + 1
                if b"".join(map(of.__getitem__, ids.tolist())) != raw or (np.cumsum(width[ids])[at - 1] != ends).any():
                    break
                first = np.concatenate([[0], at[:-1]])
                keep = np.ones(len(ids), bool)
                for k in range(letter):
                    keep[first[on[p]] + k] = False
                mine.append((ids[keep], at - first - letter * on[p], np.ones(len(at), bool)))
            for out, x in zip(found, mine if len(mine) == 2 else self.one_by_one(units[p]), strict=True):
                out.append(x)
        return [tuple(map(np.concatenate, zip(*x, strict=True))) for x in found]


@lru_cache(2)
def load(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


@lru_cache(1)
def _written(n: int) -> list[str]:
    """Ids below n as text before a comma, a bar and a semicolon."""
    return [f"{i}{c}" for c in ",|;" for i in range(n)]


class Links:
    """Tokens, groups and links of distinct units, in an order of its own (`units`)."""

    def __init__(self, units: list, made: Tokenizers):
        visible = [made.cuts and isinstance(u, str) and not (u[0].isspace() or u[-1].isspace()) for u in units]
        order = np.argsort(~np.array(visible, bool), kind="stable")
        units = [units[i] for i in order.tolist()]
        self.units, n = units, sum(visible)
        sides = [f(part) for f, part in ((made.together, units[:n]), (made.one_by_one, units[n:])) if part]
        (self.a, self.n_a, self.ok), (self.b, self.n_b, _) = (tuple(map(np.concatenate, zip(*(x[side] for x in sides), strict=True))) for side in (0, 1))
        a, b = self._incidence(self.a, made.widths[0]), self._incidence(self.b, made.widths[1])
        self.overlaps = product(a, b.transposed())  # tokens by tokens, the bytes in common
        last, first = self.overlaps.columns[self.overlaps.start[1:] - 1], self.overlaps.columns[self.overlaps.start[:-1]]
        cut = np.append(last[:-1] < first[1:], True)[: len(self.a)]
        self.group_a = np.cumsum(cut) - cut
        self.group_b = np.zeros(len(self.b), np.int64)
        self.group_b[self.overlaps.columns] = self.group_a[self.overlaps.rows()]
        n = int(cut.sum())
        unit = np.repeat(np.arange(len(units)), self.n_a)
        self.n_groups = np.bincount(unit[cut], minlength=len(units))
        # rows of the group incidences: the distinct (unit, id), so that repeated tokens are one row with a count
        rows_a, at_a = np.unique((unit << 32) | self.a, return_inverse=True)
        rows_b, at_b = np.unique(self.b, return_inverse=True)
        by_a = Csr.of(at_a, self.group_a, np.ones(len(at_a)), (len(rows_a), n))
        by_b = Csr.of(at_b, self.group_b, np.ones(len(at_b)), (len(rows_b), n))
        shared = product(by_a, by_b.transposed())
        owner = rows_a >> 32
        self.start = shared.start[np.searchsorted(owner, np.arange(len(units) + 1))]
        self.pairs = ((rows_a & 0xFFFFFFFF)[shared.rows()] << 32) | rows_b[shared.columns]
        self.links = shared.values
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(self.links)])[self.start])
        self.shown = self._show(len(units))

    @staticmethod
    def _incidence(ids: np.ndarray, widths: np.ndarray) -> Csr:
        start = np.concatenate([[0], np.cumsum(widths[ids])])
        return Csr(start, np.arange(start[-1]), np.ones(start[-1], np.int64), int(start[-1]))

    def _show(self, n: int) -> list[bytes]:
        """The groups of each unit as text."""
        top = int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1
        ends = [np.append(g[1:] != g[:-1], True)[: len(g)] for g in (self.group_a, self.group_b)]
        code = np.concatenate([self.a + top * ends[0], self.b + 2 * top * ends[1]])
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        words = list(map(_written(1 << top.bit_length()).__getitem__, (code // top * (1 << top.bit_length()) + code % top)[order].tolist()))
        at = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(words[i:j])[:-1].encode() for i, j in zip(at[:-1], at[1:], strict=True)]


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, *shape: int):
        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            grown = np.zeros((2 * (self.n + len(more)), *self.held.shape[1:]), np.int64)
            grown[: self.n] = self.held[: self.n]
            self.held = grown
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


class _Known:
    """The aligned units of a task, up to a bound on their characters and links; then it starts anew."""

    def __init__(self, made: Tokenizers):
        self.made = made
        self.clear()

    def clear(self) -> None:
        self.place: dict = {}
        self.chars, self.shown = 0, []
        self.numbers, self.start, self.pairs, self.links = _Grown(5), _Grown(), _Grown(), _Grown()
        self.start.add(np.zeros(1, np.int64))

    def of(self, units: list) -> np.ndarray:
        """Places of the units; they hold until the next call."""
        if self.chars > MOST_CHARS or self.pairs.n > MOST_LINKS:
            self.clear()
        fresh = list(set(units).difference(self.place))
        if fresh:
            new = Links(fresh, self.made)
            fresh = new.units
            self.place.update(zip(fresh, range(len(self.shown), len(self.shown) + len(fresh)), strict=True))
            self.chars += sum(map(len, fresh))
            self.shown += new.shown
            self.numbers.add(np.stack([new.n_a, new.n_b, new.n_groups, new.n_links, ~new.ok], 1))
            self.start.add(self.start.held[self.start.n - 1] + new.start[1:])
            self.pairs.add(new.pairs)
            self.links.add(new.links)
        found = np.array(list(map(self.place.__getitem__, units)), np.int64)
        for unit in [u for u in fresh if isinstance(u, tuple) or len(u) > LONGEST]:
            del self.place[unit]  # long units hardly come again
        return found


def _cut(text: str, cuts: bool) -> Iterator[str]:
    """A text in pieces of about PIECE characters, which end between units."""
    a = 0
    while cuts and _ON not in text and len(text) - a > PIECE:
        gap = _UNITS.search(text, a + PIECE)
        if not gap:
            break
        yield text[a : gap.start()]
        a = gap.end()
    yield text[a:]


def _gathered(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)


def _aligned(a_path: str, b_path: str, keep: list[str]):
    """Numbers and text digest of each document, and its distinct pairs (a, b) with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = load(a_path, b_path)
        known = _Known(made)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            numbers, digests, a, b, links = np.zeros((len(texts), 5), np.int64), [""] * len(texts), [], [], []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= PIECE):
                    size += len(texts[j] or "")
                    j += 1
                sums = [hashlib.sha256() for _ in range(i, j)]
                keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                pieces = [[(texts[k] or "")] for k in range(i, j)] if j > i + 1 else [_cut(texts[i] or "", made.cuts)]
                for turn, parts in enumerate(zip(*pieces, strict=True)):
                    units = [made.units(p) for p in parts]
                    size = np.array([len(u) for u in units])
                    at = known.of(list(chain.from_iterable(units)))
                    doc = np.repeat(np.arange(j - i), size)
                    ends = np.cumsum(size)
                    totals = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(known.numbers.held[at], 0)])
                    numbers[i:j] += totals[ends] - totals[ends - size]
                    for k, (x, y) in enumerate(zip((ends - size).tolist(), ends.tolist(), strict=True)):
                        if y > x:
                            sums[k].update((b";" if turn else b"") + b";".join(map(known.shown.__getitem__, at[x:y].tolist())))
                    begin = known.start.held[at]
                    each = known.start.held[at + 1] - begin
                    entry = np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    pair, place = np.unique(known.pairs.held[entry], return_inverse=True)
                    key, n = _gathered([np.repeat(doc, each) * max(len(pair), 1) + place], [known.links.held[entry]])
                    part = (key // max(len(pair), 1), pair[key % max(len(pair), 1)] if len(pair) else key, n)
                    keys, counts, docs = (keys + [part[1]], counts + [part[2]], part[0])
                if len(keys) > 2:  # a text in pieces
                    pair, n = _gathered(keys, counts)
                    docs = np.zeros(len(pair), np.int64)
                else:
                    pair, n = keys[1], counts[1]
                good = numbers[i:j, 4] == 0
                docs, pair, n = docs[good[docs]], pair[good[docs]], n[good[docs]]
                numbers[i:j][~good] = 0
                for k in range(j - i):
                    if numbers[i + k, 0]:
                        digests[i + k] = sums[k].hexdigest()
                bounds = np.searchsorted(docs, np.arange(j - i + 1))
                a.append((bounds, pair >> 32))
                b.append(pair & 0xFFFFFFFF)
                links.append(n)
                i = j
            offsets = np.concatenate([[0], *(np.diff(x[0]) for x in a)]).cumsum() if a else np.zeros(1, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *v]), t)) for v, t in (([x[1] for x in a], pa.int32()), (b, pa.int32()), (links, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(digests, pa.string()), *lists], names=[*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "links"])

    return run


def _counted(head, keep: list[str], rest: bool):
    """Sums over links of the counts in `head` (sorted pairs, counts, whether it is the a's highest), and with `rest` the pairs that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = head.value
        for batch in batches:
            a, b, links = (batch.column(c) for c in ("a", "b", "links"))
            offsets = a.offsets.to_numpy() - a.offsets[0].as_py()
            key, n = (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy(), links.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
            found = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
            total, top = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            total[found] = counts[at[found]] * n[found]
            top[found] = best[at[found]] * n[found]
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (top, total)]
            columns = {"n_best": pa.array(sums[0][offsets[1:]] - sums[0][offsets[:-1]]), "count_sum": pa.array(sums[1][offsets[1:]] - sums[1][offsets[:-1]])}
            if rest:
                left = np.concatenate([[0], np.cumsum(~found)])[offsets]
                columns["rest"] = pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.StructArray.from_arrays([pa.array(key[~found]), pa.array(n[~found])], names=["pair", "n"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns.values()], names=[*keep, *columns])

    return run


def _head(counts: DataFrame, most: int) -> tuple[tuple, bool]:
    """The commonest pairs, as many whole levels of their counts (eight to a doubling) as have at most `most` pairs together; and whether these are not all."""
    level = F.floor(F.log2("n") * 8)
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect(), reverse=True)
    taken, least = 0, None
    for r in levels:
        if taken + r["pairs"] > most:
            break
        taken, least = taken + r["pairs"], r["level"]
    found = counts.filter(level >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    pair = found["pair"].to_numpy()
    by = np.argsort(pair)
    return (pair[by], found["n"].to_numpy()[by], found["best"].to_numpy()[by]), taken < sum(r["pairs"] for r in levels)


def align(docs: DataFrame, keep: list[str] | None = None, a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}", head: int = HEAD, pairs: bool = False) -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 to the columns `keep` (all) of (text, ...).

    A byte-level vocabulary (a file of the `tokenizers` library) encodes a space and the text, a piece vocabulary (a `sentencepiece` model that adds the space) the text. Groups are
    cut where both end a token, links are all pairs of tokens in a group. A pair of ids counts the documents that hold it linked; n_best are the links whose
    count is the highest of their a, count_sum adds the counts of all links. groups_sha256 is of the groups written as `a,a|b;a|b,b`. With
    `pairs`, also pairs, an array of (a, b, links).
    Texts that are null, empty, or that the tokens don't spell byte for byte have zeros and ''. Repeated rows are documents of their own; an empty table gives an
    empty result. Long texts are taken whole, in pieces; one without single spaces is one piece. Columns of the new names are replaced.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "links", "n_best", "count_sum", "pairs"]
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = packed(docs, kept, F.col("text"))
    numbers = ", ".join(f"{c} long" for c in new[:4])
    found = stash(rows.mapInArrow(_aligned(a_path, b_path, ["__row"]), schema_of(rows, ["__row"], f"{numbers}, groups_sha256 string, a array<int>, b array<int>, links array<long>")))
    counts = stash(found.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")))
    highest = counts.groupBy(F.col("a").alias("__a")).agg(F.max("n").alias("highest"))
    ranked = stash(counts.join(highest, F.col("a") == F.col("__a")).select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"), "n", (F.col("n") == F.col("highest")).alias("best")))
    discard(counts)
    arrays, more = _head(ranked, head)
    keep = ["__row", *new[:5], *(("a", "b", "links") if pairs else ()), *(("__rid",) if more else ())]
    rows = with_rid(found, "__rid") if more else found
    columns = sorted({*keep, "a", "b", "links"})
    summed = rows.select(*columns).mapInArrow(_counted(spark.sparkContext.broadcast(arrays), keep, more), schema_of(rows, keep, "n_best long, count_sum long" + (", rest array<struct<pair:long,n:long>>" if more else "")))
    if more:
        summed = stash(summed)
        rest = summed.select("__rid", F.inline("rest").alias("pair", "times")).join(ranked.withColumnRenamed("n", "count"), "pair")
        sums = rest.groupBy("__rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("count") * F.col("times")).alias("more_sum"))
        with_rest = summed.join(sums, "__rid", "left")
        summed = with_rest.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    if pairs:
        summed = summed.withColumn("pairs", F.arrays_zip("a", "b", "links"))
    return unpacked(summed, *new[:4], "n_best", "count_sum", "groups_sha256", *(["pairs"] if pairs else []))


def _units(a_path: str, b_path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, known = load(a_path, b_path), {}
        group = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
        link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                groups, overlaps, at = [], [], np.zeros(2, np.int64)
                for part in _cut(text or "", made.cuts):
                    ok = True
                    for unit in made.units(part):
                        if unit not in known:
                            known[unit] = Links([unit], made)
                        links, ok = known[unit], ok and known[unit].ok.all()
                        if not ok:
                            break
                        groups += [dict(zip("ab", (list(map(int, x.split(","))) for x in g.split("|")), strict=True)) for g in links.shown[0].decode().split(";")]
                        o = links.overlaps
                        overlaps += [{"a": x, "b": y, "bytes": n} for x, y, n in zip((o.rows() + at[0]).tolist(), (o.columns + at[1]).tolist(), o.values.tolist(), strict=True)]
                        at += [len(links.a), len(links.b)]
                    if not ok:
                        groups, overlaps = [], []
                        break
                    if len(known) > 20_000:
                        known.clear()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in keep), pa.array([groups], pa.list_(group)), pa.array([overlaps], pa.list_(link))], names=[*keep, "groups", "overlaps"])

    return run


def token_links(docs: DataFrame, keep: list[str], a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}") -> DataFrame:
    """The columns `keep` with each text's groups (ids of both vocabularies) and overlaps (places of an a and a b token, and the bytes in common)."""
    small_batches(docs.sparkSession)
    rows = packed(docs, keep, F.col("text"))
    schema = schema_of(rows, ["__row"], "groups array<struct<a:array<int>,b:array<int>>>, overlaps array<struct<a:int,b:int,bytes:int>>")
    return unpacked(rows.mapInArrow(_units(a_path, b_path, ["__row"]), schema), "groups", "overlaps")
