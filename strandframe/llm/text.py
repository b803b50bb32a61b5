"""Vectorised hashing of the bytes and words in Arrow batches of texts.

Hashes are polynomials modulo 2**64 over random byte values, so the hash of any
stretch comes from two prefix sums, whatever its place in the buffer. They find what may be
equal. Modulo a power of two, Thue-Morse strings of 1,024 bytes and their complements are equal whatever the
values are; therefore long words are hashed by BLAKE2b, and what decides whether stretches are equal
is `digests` of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = 0xD1342543DE82EF95 | 1
_WORD_INVERSE = pow(_WORD_BASE, -1, 1 << 64)
#: Bytes hashed at once; longer texts are hashed piece by piece.
PIECE = 1 << 20

BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

#: Words of more bytes are hashed by BLAKE2b.
LONG_WORD = 64

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = _INVERSE) -> np.ndarray:
    """Hashes of values[start:end] from prefix_sums(values)."""
    return mix((sums[end] - sums[start]) * powers(inverse, len(sums))[start] + (end - start).astype(np.uint64))


def word_prefix_sums(words: np.ndarray) -> np.ndarray:
    return prefix_sums(words, _WORD_BASE)


def word_stretch_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return stretch_hashes(sums, start, end, _WORD_INVERSE)


def digests(stretches: Iterable[bytes], size: int = 16) -> np.ndarray:
    """BLAKE2b of each stretch, as rows of 64-bit words."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=size).digest() for x in stretches]), "<u8").reshape(-1, size // 8)


def spelled(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text with single spaces between them, and where they begin and end there."""
    found = text.split()
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    return b" ".join(found), end - size, end


def binary_column(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow binary column; nulls are empty."""
    n = len(column)
    width = np.int64 if str(column.type).startswith("large") else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.diff(offsets)
        if lengths[~np.asarray(column.is_valid())].any():  # a null that covers bytes
            kept = [x or b"" for x in column.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)
            data = np.frombuffer(b"".join(kept), np.uint8)
    return data, offsets


def groups_of_docs(offsets: np.ndarray, most: int = PIECE):
    """Ranges (i, j) of documents of at most `most` bytes together, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _words_at_once(data: np.ndarray, bounds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~IS_BLANK[data]
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = stretch_hashes(prefix_sums(values[data]), start, end)
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        word = data[start[k] : end[k]].tobytes()
        hashes[k] = digests([word.lower() if values is FOLDED_VALUES else word], 8)[0, 0]
    return hashes, start


def words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of several documents, and where each document's words begin (one more entry than documents)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi - lo <= 2 * PIECE or len(offsets) > 2:
        hashes, start = _words_at_once(data[lo:hi], offsets - lo, values)
        return hashes, np.searchsorted(start, offsets - lo)
    found, at = [], lo
    while at < hi:  # one long document: pieces that end between words
        to = min(hi, at + PIECE)
        while to < hi:
            blank = np.flatnonzero(IS_BLANK[data[at:to]])
            if len(blank):
                to = at + int(blank[-1]) + 1
                break
            to = min(hi, to + PIECE)
        found.append(_words_at_once(data[at:to], np.zeros(0, np.int64), values)[0])
        at = to
    hashes = np.concatenate(found)
    return hashes, np.array([0, len(hashes)])
