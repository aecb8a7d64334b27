"""Ratcliff-Obershelp likeness of many pairs at a time, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _codes(texts: list[str], n: np.ndarray, pad: int) -> np.ndarray:
    out = np.full((len(texts), max(1, int(n.max(initial=0)))), pad, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat
    return out


def _longest(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of part (pair, a from, a to, b from, b to): the longest common run within both ranges, the first in a, then in
    b: its size and its places."""
    pair, a0, a1, b0, b1 = part.T
    columns = np.arange(b.shape[1])
    inside = (columns >= b0[:, None]) & (columns < b1[:, None])
    before = np.zeros((len(part), b.shape[1] + 1), np.int32)
    size, at_a, at_b = np.zeros(len(part), np.int64), a0.copy(), b0.copy()
    every = np.arange(len(part))
    for i in range(int(a0.min()), int(a1.max())):
        now = np.zeros_like(before)
        hit = (a[pair, i][:, None] == b[pair]) & inside & ((i >= a0) & (i < a1))[:, None]
        np.copyto(now[:, 1:], before[:, :-1] + 1, where=hit)
        j = now.argmax(axis=1)
        best = now[every, j]
        more = best > size
        size[more], at_a[more], at_b[more] = best[more], i + 1 - best[more], j[more] - best[more]
        before = now
    return size, at_a, at_b


def matching_characters(a: list[str], b: list[str]) -> np.ndarray:
    """The characters of the longest common run of each pair, and so on to both sides of it."""
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    total = np.zeros(len(a), np.int64)
    if not len(a):
        return total
    ca, cb = _codes(a, na, -1), _codes(b, nb, -2)
    part = np.stack([np.arange(len(a)), np.zeros_like(na), na, np.zeros_like(nb), nb], axis=1)
    part = part[(na > 0) & (nb > 0)]
    while len(part):
        size, i, j = _longest(ca, cb, part)
        np.add.at(total, part[:, 0], size)
        pair, a0, a1, b0, b1 = part.T
        sides = np.concatenate([np.stack([pair, a0, i, b0, j], axis=1), np.stack([pair, i + size, a1, j + size, b1], axis=1)])
        found = np.concatenate([size, size]) > 0
        part = sides[found & (sides[:, 1] < sides[:, 2]) & (sides[:, 3] < sides[:, 4])]
    return total


def ratios(a: list[str], b: list[str], cells: int = 400_000) -> np.ndarray:
    """2 * matching characters / all characters; 1 for two empty texts. Pairs go in groups of like length, of about `cells`
    characters each, so scratch memory doesn't grow with the batch."""
    n = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    out = np.ones(len(a))
    order, at = np.argsort(n, kind="stable"), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * n[order[to]] <= cells:
            to += 1
        own = order[at:to]
        x, y = [a[k] for k in own], [b[k] for k in own]
        both = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64)
        np.divide(2.0 * matching_characters(x, y), both, out=(part := np.ones(len(own))), where=both > 0)
        out[own] = part
        at = to
    return out


def _share(a: list[str], b: list[str], slots: int = 64) -> np.ndarray:
    """At least the number of characters that can match: those that both have, by the remainder of their codes."""
    counts = []
    for texts in (a, b):
        n = np.array([len(x) for x in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32) % slots
        counts.append(np.bincount(np.repeat(np.arange(len(texts)), n) * slots + codes, minlength=len(texts) * slots).reshape(len(texts), slots))
    return np.minimum(*counts).sum(axis=1)


def ratios_from(a: list[str], b: list[str], least: float) -> np.ndarray:
    """ratios of the pairs that may reach `least`, 0 for those whose characters alone rule that out."""
    out = np.zeros(len(a))
    both = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    may = np.flatnonzero(2 * _share(a, b) + 1e-9 >= least * both)
    out[may] = ratios([a[i] for i in may], [b[i] for i in may])
    return out


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Twice the matching characters over all characters, longest common runs first (of equally long ones the first in a, then in
    b, so the order of the two counts). Null if either is null; 0 is also told of pairs that can't reach `least`."""

    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        there = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[there] = ratios_from(x[there].tolist(), y[there].tolist(), least)
        return pd.Series(out).where(there, None)

    return F.pandas_udf(alike, DoubleType())(a, b)
