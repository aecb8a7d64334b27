"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import slices

_U = np.uint64
_CHUNK = 1 << 14
#: Characters whose n-grams are held at once.
_PIECE = 500_000


@dataclass(frozen=True)
class Settings:
    """sizes: n-gram lengths in characters. bits: of the feature hash. alpha: smoothing of counts.

    shrink: every log-count ratio is drawn towards 0 by so many standard errors; n-grams whose ratio is 0 then say nothing.
    sample_rows: at most about so many labelled documents, picked by a hash of doc_id, fit the linear weights on the driver, and
    fewer if their lists of n-grams could exceed sample_bytes; counts and ratios come from all labelled rows. penalty, steps: of
    the fit.
    """

    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    alpha: float = 1.0
    shrink: float = 2.5
    sample_rows: int = 10_000
    sample_bytes: int = 200_000_000
    penalty: float = 1e-4
    steps: int = 150


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # of each feature, its ratio multiplied in
    intercept: float
    settings: Settings


def present(texts: list[str], settings: Settings, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each distinct n-gram of each lower-cased text, sorted; table: keeps features with a True there.

    Long texts are read in overlapping pieces, so scratch memory doesn't grow with them.
    """
    found, rows, pieces, size = [], [], [], 0
    for i, x in enumerate(texts):
        low = x.lower()
        for a in range(0, len(low), _PIECE):
            rows.append(i)
            pieces.append(low[a : a + _PIECE + max(settings.sizes) - 1])
            size += len(pieces[-1])
            if size >= _PIECE:
                found.append(_distinct(_keys(rows, pieces, settings, table)))
                rows, pieces, size = [], [], 0
    if pieces:
        found.append(_keys(rows, pieces, settings, table))
    keys = _distinct(np.concatenate([*found, np.zeros(0, np.int64)]))
    return keys >> settings.bits, keys & ((1 << settings.bits) - 1)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _keys(rows: list[int], pieces: list[str], settings: Settings, table: np.ndarray | None) -> np.ndarray:
    """row << bits | feature of each n-gram of the pieces, which belong to these rows."""
    n_chars = np.array([len(x) for x in pieces], np.int64)
    code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.array(rows, np.int64), n_chars)
    end = np.repeat(np.cumsum(n_chars), n_chars)
    place = np.arange(len(code))
    found = []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(settings.sizes) + 1):
        h = h[: len(code) - n + 1]
        h = (h + code[n - 1 :] + _U(1)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        if n in settings.sizes and len(h):
            bucket = ((h * _U(0xBF58476D1CE4E5B9)) >> _U(64 - settings.bits)).astype(np.int64)
            ok = place[: len(h)] + n <= end[: len(h)]
            if table is not None:
                ok &= table[bucket]
            ok = np.flatnonzero(ok)
            found.append((row[ok] << settings.bits) | bucket[ok])
    return np.concatenate([*found, np.zeros(0, np.int64)])


def _count(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << settings.bits), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                label = (part.column("label").to_numpy(zero_copy_only=False) > 0).astype(np.int64)
                rows += np.bincount(label, minlength=2)
                row, feature = present([x or "" for x in part.column("text").to_pylist()], settings)
                for k in (0, 1):
                    counts[k] += np.bincount(feature[label[row] == k], minlength=1 << settings.bits)
        if rows.any():
            out = [(-1, rows.tobytes())]
            for c in range(0, 1 << settings.bits, _CHUNK):
                out.append((c, zlib.compress(counts[:, c : c + _CHUNK].tobytes(), 1)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["chunk", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    """The sum of the counts of one chunk."""
    chunk = table["chunk"][0].as_py()
    total: np.ndarray | int = 0
    for x in table["counts"]:
        total = total + np.frombuffer(x.as_py() if chunk < 0 else zlib.decompress(x.as_py()), np.int64)
    return pa.table({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})  # type: ignore[union-attr]


def _list(settings: Settings, features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << settings.bits, bool)
        table[features] = True
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature = present([x or "" for x in part.column("text").to_pylist()], settings, table)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(lists, pa.binary())], names=["doc_id", "label", "features"])

    return run


def fit_weights(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by their ratio (Nesterov steps on the penalised loss)."""
    n, d = len(rows), len(ratio)
    index = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in rows])
    value = ratio[index]
    share = np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6)
    w, b = np.zeros(d), float(np.log(share / (1 - share)))
    # a bound of the curvature for each feature: a quarter of its mean square times the features of a row
    many = np.maximum(np.bincount(row, weights=np.abs(value), minlength=n), 1.0)
    bound = np.bincount(index, weights=np.abs(value) * many[row], minlength=d) / (4 * max(n, 1)) + settings.penalty
    look_w, look_b, pace = w.copy(), b, 1.0
    for _ in range(settings.steps):
        margin = np.bincount(row, weights=value * look_w[index], minlength=n) + look_b
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        slope = np.bincount(index, weights=value * error[row], minlength=d) / max(n, 1) + settings.penalty * look_w
        new_w, new_b = look_w - slope / bound, look_b - error.mean() * 2 if n else look_b
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look_w, look_b = new_w + (pace - 1) / after * (new_w - w), new_b
        w, b, pace = new_w, new_b, after
    return w, b


def shrunk_ratios(counts: np.ndarray, rows: np.ndarray, settings: Settings) -> np.ndarray:
    """The log-count ratio of each n-gram - how much likelier it is in a toxic document - less `shrink` standard errors."""
    a = settings.alpha
    n = rows[:, None] + 2 * a
    ratio = np.log((counts[1] + a) / n[1]) - np.log((counts[0] + a) / n[0])
    error = np.sqrt(np.maximum((1 / (counts + a) - 1 / n).sum(0), 0))
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - settings.shrink * error)
    return np.where(counts.sum(0) > 0, ratio, 0)


def train(labelled: DataFrame, known: int, settings: Settings | None = None) -> Model:
    """labelled(doc_id, text, label): every row to learn from; known: about how many documents these are."""
    settings = settings or Settings()
    size = 1 << settings.bits
    summed = labelled.select("text", "label").mapInArrow(_count(settings), "chunk int, counts binary")
    summed = summed.groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect()  # size / _CHUNK + 1 rows
    counts, rows = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
    for r in summed:
        got = np.frombuffer(r["counts"], np.int64)
        if r["chunk"] < 0:
            rows = got
        else:
            counts[:, r["chunk"] : r["chunk"] + _CHUNK] = got.reshape(2, -1)
    ratio = shrunk_ratios(counts, rows, settings)
    features = np.flatnonzero(ratio)
    share = min(settings.sample_rows, settings.sample_bytes / 4 / max(1, len(features))) / max(known, 1)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, share)))
    lists = sample.select("doc_id", "text", "label").mapInArrow(_list(settings, features), "doc_id long, label long, features binary")
    # one row for each document: an id that holds many rows counts once
    got = lists.groupBy("doc_id").agg(F.max(F.struct("label", "features")).alias("row")).select("row.*").collect()
    found = [np.searchsorted(features, np.frombuffer(r["features"], np.int32)) for r in got]
    y = np.array([float(r["label"] > 0) for r in got])
    w, b = fit_weights(found, y, ratio[features], settings)
    return Model(features, w * ratio[features], b, settings)


def _score(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << model.settings.bits
        table, weight = np.zeros(size, bool), np.zeros(size)
        table[model.features] = True
        weight[model.features] = model.weights
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature = present([x or "" for x in part.column("text").to_pylist()], model.settings, table)
                margin = np.bincount(row, weights=weight[feature], minlength=part.num_rows) + model.intercept
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(score)], names=[*columns, "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """True for the rows whose label is never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id long, text), labels(doc_id, toxic) -> (doc_id, held_out, score, predicted), a row for each row of docs.

    Only labels of rows that aren't held out are learnt from; a document with several labels counts as toxic if one says
    so, null labels and labels without a document are ignored. Null and empty texts have no n-grams and get the score of the
    intercept. Other columns of either table are ignored; repeated rows get equal scores and are counted as often as they stand
    there. An empty table gives no rows. Without labelled rows of both classes every score is about the
    share of toxic ones (0.5 without any).
    """
    settings = settings or Settings()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("label"))
    known = known.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    # the same plan at every size: labels grow with the input, so neither side is broadcast
    labelled = docs.where(~held_out(F.col("doc_id"))).join(known.hint("merge"), "doc_id")
    model = train(labelled, known.count(), settings)
    flagged = docs.withColumn("held_out", held_out(F.col("doc_id")))
    out = flagged.mapInArrow(_score(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
