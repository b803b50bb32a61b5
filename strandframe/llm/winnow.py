"""Cut sequences into stretches whose windows share a minimizer.

Each window of `width` symbols takes the k-gram of least hash in it (the last of
equals). Neighbouring windows that take the same one form a stretch. Equal windows
take equal k-grams at equal offsets, wherever they stand, so windows need to be
compared only within the rows of one k-gram hash.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Positions handled at once: the position shares a word with the hash.
_BITS = 20
MOST = 1 << _BITS


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _stretches(grams: np.ndarray, room: np.ndarray, owner: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """First and last window and minimizer's place of each stretch. room: whether a window that starts here ends in its document."""
    w = width - k + 1
    place = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min((grams & ~U(MOST - 1)) | (U(MOST - 1) - place), w)
    at = (U(MOST - 1) - (least & U(MOST - 1))).astype(np.int64)
    start = np.flatnonzero(room[: len(at)])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    at = at[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (owner[start[1:]] != owner[start[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last], at[first]


def stretches(gram_hashes, n: int, bounds: np.ndarray, width: int, k: int):
    """Yield (first window, last window, minimizer's place, its hash, document) arrays.

    gram_hashes(a, b): hashes of the k-grams that start at a..b-1. bounds: where the
    documents begin in the n symbols, and n. Long inputs go in overlapping pieces, so
    that each window belongs to exactly one of them.
    """
    step = MOST - width
    for a in range(0, max(n - width + 1, 0), step):
        windows = min(step, n - width + 1 - a)
        grams = gram_hashes(a, a + windows + width - k)
        lo = int(np.searchsorted(bounds, a, "right")) - 1
        ends = bounds[lo + 1 :]
        at = a + np.arange(windows)
        owner = lo + np.searchsorted(ends, at, "right")
        room = at + width <= bounds[owner + 1]
        first, last, place = _stretches(grams, room, owner, width, k)
        if len(first):
            yield a + first, a + last, a + place, grams[place], owner[first]
