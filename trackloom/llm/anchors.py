"""Anchors: content-chosen positions by which repeated windows find each other.

A window is ``length`` consecutive units (bytes, or hashes of words). Of the ``length - gram + 1`` grams in it,
the one with the least hash, the leftmost of equals, is its anchor. Equal windows have equal anchors at equal
places, so only about ``2 / (length - gram + 2)`` of all positions need to be indexed for an exact search. An
anchor owns a run of windows; ``context`` and ``twin`` are two hashes, of different bases, of all units under that run, of its extent and of
the anchor's place in it: 128 bits by which two rows that agree in them own equal windows one by one.

All hashes are 64-bit polynomials over mixed units, taken from prefix sums, in numpy.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
TWIN = 0xD6E8FEB86659FD93 | 1
#: A text longer than this is searched in pieces that overlap by a window less one unit.
PIECE = 1 << 20

_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, n of each at least."""
    if base not in _cache or len(_cache[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _cache[base] = both[0], both[1]
    return _cache[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Mixed value of each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Rolling:
    """Hashes of any range of a sequence of mixed 64-bit units."""

    def __init__(self, units: np.ndarray, base: int = BASE):
        up, self.down = _powers(len(units) + 1, base)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[: len(units)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        """Hashes of all ranges of ``width`` units."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    if step < width:
        out = np.minimum(out[: len(out) - (width - step)], out[width - step :])
    return out


class Found(NamedTuple):
    anchor: np.ndarray
    context: np.ndarray
    twin: np.ndarray
    piece: np.ndarray  # number of the piece
    first: np.ndarray  # first window owned, from the piece's start
    size: np.ndarray  # windows owned
    place: np.ndarray  # of the anchor, from the first window's start


def anchors(units: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Found:
    """Anchors of pieces that stand one after another in ``units`` and end at ``ends``."""
    none, no = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(units)
    if n < length:
        return Found(no, no, no, none, none, none, none)
    rolling = Rolling(units)
    g = rolling.all(gram)
    least = sliding_min(g, length - gram + 1)
    begins = np.r_[0, ends[:-1]]
    valid = np.zeros(len(least) + 1, np.int8)
    keep = ends - begins >= length
    valid[begins[keep]] += 1
    np.add.at(valid, np.minimum(ends[keep] - length + 1, len(least)), -1)
    valid = np.cumsum(valid[:-1]) > 0
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (g[: len(least) - 1] == least[:-1]) | ~valid[:-1]
    fresh[begins[begins < len(fresh)]] = True
    fresh &= valid
    first = np.flatnonzero(fresh)
    if not len(first):
        return Found(no, no, no, none, none, none, none)
    stops = np.flatnonzero(fresh | ~valid)
    after = np.searchsorted(stops, first, "right")
    last = np.where(after < len(stops), stops[np.minimum(after, len(stops) - 1)], len(least)) - 1
    value, at = least[first], last.copy()
    seek = np.flatnonzero(g[at] != value)
    while len(seek):  # the anchor is the first place from the last window's start on that holds the least hash
        at[seek] += 1
        seek = seek[g[at[seek]] != value[seek]]
    size, place = last - first + 1, at - first
    extent = mix((size.astype(np.uint64) << np.uint64(20)) | place.astype(np.uint64))
    context, twin = (mix(r(first, last + length) ^ extent) for r in (rolling, Rolling(units, TWIN)))
    piece = np.searchsorted(ends, first, "right")
    return Found(value, context, twin, piece, first - begins[piece], size, place)


def cover(starts: np.ndarray, sizes: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask of the units covered by runs of windows (first window, number of windows)."""
    mark = np.zeros(total + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + sizes + length - 1, total), -1)
    return np.cumsum(mark[:-1]) > 0
