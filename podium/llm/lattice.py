"""Sums over all segmentations of words into pieces of a vocabulary: forward and backward in log space, many words at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_PAD = 300  # no byte: what it stands in matches no piece
#: Longer words are summed alone; words times their length are at most _CELLS at a time.
LONG, _CELLS = 64, 1 << 16


class Pieces:
    """Finds the number of the piece that equals a substring, by rolling hash; len(pieces) where there is none.

    The hash is a polynomial over bytes of 64 bits; pieces are at most some dozens of bytes long, all of different hash.
    """

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces), default=0)
        self.size = len(pieces)
        hashes = np.zeros(self.size, np.uint64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = _U(0)
                for c in p:
                    h = h * _BASE + _U(c + 1)
                hashes[i] = h
        if len(np.unique(hashes)) != self.size:
            raise ValueError("pieces must differ")
        self.hashes = np.append(hashes, _U(0))
        self.tables = []
        left, bits, odd = np.arange(self.size), 20, 0xD6E8FEB86659FD93
        while len(left):  # what shares a slot goes to a smaller table
            slot = self._slot(hashes[left], odd, bits)
            held = np.full(1 << bits, self.size, np.int32)
            held[slot[::-1]] = left[::-1]
            self.tables.append((odd, bits, held))
            left, bits, odd = left[held[slot] != left], 16, odd * 3 % (1 << 64)

    @staticmethod
    def _slot(h: np.ndarray, odd: int, bits: int) -> np.ndarray:
        return ((h * _U(odd)) >> _U(64 - bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, self.size, np.int32)
        for odd, bits, held in self.tables:
            at = held[self._slot(h, odd, bits)]
            np.copyto(out, at, where=self.hashes[at] == h)
        out[h == 0] = self.size
        return out

    def at(self, text: np.ndarray) -> Iterator[np.ndarray]:
        """text, bytes along the first axis -> for each length 1, 2, ... the piece that begins at each place."""
        code = text.astype(np.uint64) + _U(1)
        h = np.zeros(code.shape, np.uint64)
        for n in range(1, min(self.longest, len(code)) + 1):
            h = h[: len(code) - n + 1] * _BASE + code[n - 1 :]
            yield self.find(h)


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    t = np.stack(terms)
    top = t.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(t - safe).sum(axis=0)) + safe


def _even(text: np.ndarray, n: np.ndarray, pieces: Pieces, weight: np.ndarray, counts: np.ndarray | None, times: np.ndarray) -> np.ndarray:
    """text: bytes by place and word, padded; n: lengths, falling. The log sums; adds expected counts of pieces to `counts`."""
    found = list(pieces.at(text))
    most, words = text.shape
    active = np.searchsorted(-n, -np.arange(most + 1), "right")  # words of at least that length
    forward = np.full((most + 1, words), -np.inf)
    forward[0] = 0.0
    for j in range(1, most + 1):
        w = active[j]
        forward[j, :w] = _log_sum([forward[j - m, :w] + weight[found[m - 1][j - m, :w]] for m in range(1, min(j, len(found)) + 1)])
    total = forward[n, np.arange(words)]
    if counts is None:
        return total
    known = np.where(np.isfinite(total), total, np.inf)
    backward = np.full((most + 1, words), -np.inf)
    backward[n, np.arange(words)] = 0.0
    for i in range(most - 1, -1, -1):
        w = active[i + 1]
        terms = [weight[found[m - 1][i, :w]] + backward[i + m, :w] for m in range(1, min(most - i, len(found)) + 1)]
        summed = _log_sum(terms)
        inside = n[:w] > i
        backward[i, :w] = np.where(inside, summed, backward[i, :w])
        for m, term in enumerate(terms, 1):
            share = np.exp(forward[i, :w] + term - known[:w])
            hit = np.flatnonzero(share > 0)
            np.add.at(counts, found[m - 1][i, hit], share[hit] * times[hit])
    return total


def _alone(text: np.ndarray, pieces: Pieces, weight: np.ndarray, counts: np.ndarray | None, times: float, section: int = 1 << 15) -> float:
    """The same for one word of any length, in sections, so that scratch memory is a few numbers a byte."""
    n = len(text)

    def edges(at: int) -> list[list[tuple[int, int]]]:
        """(length, piece) of the pieces that begin at each place of the section."""
        stop = min(n, at + section)
        own: list[list[tuple[int, int]]] = [[] for _ in range(stop - at)]
        for m, found in enumerate(pieces.at(text[at : stop + pieces.longest - 1]), 1):
            for i in np.flatnonzero(found[: stop - at] < pieces.size).tolist():
                own[i].append((m, int(found[i])))
        return own

    value = weight.tolist()
    forward = np.full(n + 1, -np.inf)
    forward[0] = 0.0
    for at in range(0, n, section):
        for i, own in enumerate(edges(at), at):
            here = float(forward[i])
            for m, p in own:
                a, b = float(forward[i + m]), here + value[p]
                if b > a:
                    a, b = b, a
                forward[i + m] = a + math.log1p(math.exp(b - a)) if b > -math.inf else a
    total = float(forward[n])
    if counts is None:
        return total
    backward = np.full(n + 1, -np.inf)
    backward[n] = 0.0
    for at in reversed(range(0, n, section)):
        for i, own in reversed(list(enumerate(edges(at), at))):
            terms = [value[p] + float(backward[i + m]) for m, p in own]
            top = max(terms, default=-math.inf)
            if top == -math.inf:
                continue
            backward[i] = top + math.log(sum(math.exp(t - top) for t in terms))
            for (_, p), t in zip(own, terms):
                counts[p] += times * math.exp(float(forward[i]) + t - total)
    return total


def log_sums(words: list[bytes], pieces: Pieces, weight: np.ndarray, counts: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """The natural log of each word's sum over all segmentations of the product of weights (`weight`: their logs by piece).

    With `counts` (one number a piece), the expected number of times that each piece is used is added to it, words counting
    `times` each. A word that no pieces make up has -inf; an empty one 0.
    """
    weight = np.append(weight[: pieces.size], -np.inf)
    own = None if counts is None else np.zeros(pieces.size + 1)
    times = np.ones(len(words)) if times is None else times
    n = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-n, kind="stable")
    out = np.zeros(len(words))
    at = 0
    while at < len(order):
        most = int(n[order[at]])
        if most == 0:
            break
        if most > LONG:
            i = order[at]
            out[i] = _alone(np.frombuffer(words[i], np.uint8), pieces, weight, own, float(times[i]))
            at += 1
            continue
        some = order[at : at + max(1, _CELLS // most)]
        at += len(some)
        text = np.full((len(some), most), _PAD, np.uint16)
        flat = np.frombuffer(b"".join(words[i] for i in some), np.uint8)
        text[np.arange(most)[None, :] < n[some][:, None]] = flat
        out[some] = _even(np.ascontiguousarray(text.T), n[some], pieces, weight, own, times[some])
    if counts is not None:
        counts += own[: pieces.size]
    return out
