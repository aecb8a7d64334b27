"""Integer vectors: what whitening and hard-negative mining share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import col

_LONG = 2**63 - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite entries; an empty one does not."""
    fits = lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, fits), F.lit(False))


def integers(rows: DataFrame, vector: str, scale: int = 256, name: str = "x") -> DataFrame:
    """rows with the long vector floor(scale * c) of each entry c; rows without a finite vector go.

    Entries beyond the range of long stop at its ends. All vectors get the length of the longest one (1 at least): shorter
    ones are filled up with zeros, so that rows of another length are neither lost nor an error.
    """
    kept = rows.where(finite(col(vector)))
    kept = kept.withColumn(name, F.transform(col(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))))
    least, most = kept.agg(F.min(F.size(name)), F.max(F.size(name))).first()
    dim = max(1, most or 0)
    if least is None or least == dim:
        return kept
    return kept.withColumn(name, F.concat(name, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(name))))


def stack(vectors: pd.Series) -> np.ndarray:
    """The rows as one matrix of long."""
    return np.stack([np.asarray(v, np.int64) for v in vectors]) if len(vectors) else np.zeros((0, 1), np.int64)


def _most(x: np.ndarray) -> int:
    """The largest absolute value, as Python's int."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of columns as Python's ints: no overflow."""
    return x.sum(axis=0).astype(object) if _most(x) * max(1, len(x)) < _LONG else x.astype(object).sum(axis=0)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - sums, exact: long where that fits, Python's ints otherwise."""
    most = n * _most(x) + max(map(abs, sums), default=0)
    if most < _LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(x: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, exact: long where that fits, Python's ints otherwise."""
    if x.dtype == object or _most(x) ** 2 * max(1, x.shape[1]) >= _LONG:
        x = x.astype(object)
    return (x * x).sum(axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, exact; beyond the range of long they stop at its ends."""
    if _most(a) * _most(b) * max(1, a.shape[1]) < _LONG:
        return np.einsum("ij,ij->i", a, b)
    whole = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([max(-_LONG, min(_LONG, s)) for s in whole], np.int64)
