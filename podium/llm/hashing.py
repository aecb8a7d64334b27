"""Vectorised word and word-window hashes (Rabin-Karp over prefix sums, modulo 2**64)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STEP, _STEP_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_PIECE = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(10, (max(n, 1) - 1).bit_length()))[:n]


def _piece(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and hashes of one piece; `starts`: where a row begins in it."""
    word = ~IS_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[starts] = word[starts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = starts[starts > 0] - 1
    last[ends] = word[ends]
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), dtype=np.uint64)])
    return a, mix((sums[z + 1] - sums[a]) * powers(_BASE_INV, len(buf))[a] + (z - a).astype(np.uint64))


def span_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span start..stop."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), dtype=np.uint64)])
    return mix((sums[stop] - sums[start]) * powers(_BASE_INV, len(buf) + 1)[start] + (stop - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all rows, and the offsets of each row's words (as `ends` for bytes).

    Works in pieces cut before white space, so scratch memory doesn't grow with one long row.
    """
    starts = np.unique(ends[:-1][ends[:-1] < len(buf)]) if len(buf) else np.zeros(0, np.int64)
    at, hashes, places = 0, [], []
    while at < len(buf):
        to = min(len(buf), at + _PIECE)
        if to < len(buf):
            back = np.flatnonzero(IS_SPACE[buf[at + 1 : to + 1]])
            step = back[-1] + 1 if len(back) else 0
            if not step:  # one word longer than a piece
                more = np.flatnonzero(IS_SPACE[buf[to:]])
                step = (to - at) + (more[0] if len(more) else len(buf) - to)
            to = at + int(step)
        own = starts[np.searchsorted(starts, at) : np.searchsorted(starts, to)] - at
        a, h = _piece(buf[at:to], own)
        places.append(a + at)
        hashes.append(h)
        at = to
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(place, ends)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The rolling hash of `width` words from each place on (len(words) - width + 1 of them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(_STEP, len(words)), dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * powers(_STEP_INV, len(words))[:n])
