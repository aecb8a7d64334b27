"""Embedding whitening: singular vectors of centred rows (MLlib), variances with divisor n."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import discard, materialize
from podium.llm.vectors import exact_sums, integers, numerators, square_sums, stack

_LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What was learned of the fit list: its size, sums for each dimension, unit components (columns) with their variances by
    falling size, the whole variance, and how far the covariance of whitened rows is from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.total for e in self.variances]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (numerators(x, n, sums) / n).astype(float)


def _projected(x: np.ndarray, n: int, sums: list[int], components: np.ndarray, variances: np.ndarray) -> np.ndarray:
    return _centred(x, n, sums) @ components / np.sqrt(variances)


def _gather(fit: DataFrame, each, schema: str = "part string") -> list[str]:
    """One row of text from each partition that isn't empty: what `each` makes of its matrices, added up."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                own = each(stack(b["x"]))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"part": [" ".join(map(str, np.ravel(total).tolist()))]})

    return [r.part for r in fit.select("x").mapInPandas(parts, schema).collect()]


def _total(parts: list[str], kind=int) -> list:
    return [sum(own) for own in zip(*[[kind(v) for v in p.split()] for p in parts])]


def fit_whitening(vectors: DataFrame, k: int = 4, least: float = 1e-6) -> Whitening:
    """vectors(x array<long> of one length) -> the whitening by their first k components.

    Each distinct vector counts once. Rows are centred exactly, (n*x - sums) / n, before they are multiplied. MLlib's computeSVD
    gives all right singular vectors of the centred rows (all, since it then solves densely, to double precision); variances are
    squared singular values over n. Singular values under `least` times the largest one can't be told from rounding: such
    components are left out, so there may be fewer than k, and none without variance. The whole variance comes from the exact
    deviations. The driver holds one row of sums a partition and matrices of dimension by dimension.
    """
    fit = materialize(vectors.select("x").distinct(), "fit-list")
    n = fit.count()
    if not n:
        return Whitening(0, [], np.zeros((1, 0)), np.zeros(0), 0.0, 0.0)
    sums = _total(_gather(fit, exact_sums))
    deviation = sum(_total(_gather(fit, lambda x: square_sums(numerators(x, n, sums)).astype(object).sum())))
    total = deviation / n**3
    dim = len(sums)
    components, variances, error = np.zeros((dim, 0)), np.zeros(0), 0.0
    if deviation:
        centred = F.pandas_udf(lambda s: pd.Series(list(_centred(stack(s), n, sums))), "array<double>")
        rows = fit.select(array_to_vector(centred("x")).alias("v"))
        svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v")).computeSVD(dim, computeU=False, rCond=least)
        variances = svd.s.toArray()[:k] ** 2 / n
        components = svd.V.toArray()[:, : len(variances)]
        mean = np.array(_total(_gather(fit, lambda x: _projected(x, n, sums, components, variances).sum(axis=0)), float)) / n

        def products(x: np.ndarray) -> np.ndarray:
            w = _projected(x, n, sums, components, variances) - mean
            return w.T @ w

        covariance = np.array(_total(_gather(fit, products), float)).reshape(len(variances), -1) / n
        error = float(np.abs(covariance - np.eye(len(variances))).max())
    discard(fit)
    return Whitening(n, sums, components, variances, total, error)


def apply_whitening(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vectors(x, ...) -> with whitened array<double>, one value a component, and deviation long: the sum over dimensions of
    (n*x - sums)^2, exact; null where that is beyond long (n of many millions)."""
    n, sums, components, variances = model.n, model.sums, model.components, model.variances

    def both(s: pd.Series) -> pd.DataFrame:
        x = stack(s)
        squares = square_sums(numerators(x, n, sums))
        deviation = pd.Series([int(v) if v <= _LONG else None for v in squares], dtype="Int64")
        return pd.DataFrame({"deviation": deviation, "whitened": list(_projected(x, n, sums, components, variances))})

    out = vectors.withColumn("__both", F.pandas_udf(both, "deviation long, whitened array<double>")("x"))
    return out.withColumn("deviation", F.col("__both.deviation")).withColumn("whitened", F.col("__both.whitened")).drop("__both")


def whiten_embeddings(rows: DataFrame, vector: str = "embedding", k: int = 4) -> DataFrame:
    """rows(vec_id, vector) -> a row for each remaining row and component: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null or holds null or non-finite entries go; entries become floor(256*c), stopped at the ends of long;
    shorter vectors (empty ones too) are filled up with zeros. Repeated vectors count once in the fit, each row is answered,
    null and repeated vec_ids too. Equal variances: their components are one basis of many. Without variance (an empty table,
    one vector only) there are no components and no rows. Other columns aren't read, whatever their names.
    """
    whole = integers(rows.select("vec_id", F.col(vector).alias("__vector")), "__vector").select("vec_id", "x")
    model = fit_whitening(whole, k)
    out = apply_whitening(whole, model) if len(model.variances) else whole.where(F.lit(False)).selectExpr("vec_id", "0L as deviation", "array(0D) as whitened")
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained]) if model.explained else F.array(F.lit(0.0))
    return out.select(
        "vec_id",
        (F.col("__at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation"),
        "whitened",
        F.get(explained, F.col("__at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
