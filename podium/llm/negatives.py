"""Hard negatives: exact top scores by an orthogonal rotation whose leading components rule most pairs out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.llm.common import discard, materialize, ranked, shared_dir
from podium.llm.vectors import inner, integers

_LEAST, _MOST = -(2**63 - 1), 2**63 - 1
FOUND = "anchor_row long, slot int, score long, id long, row long"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 1), np.int64)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Null ids come last."""
    return np.asarray(column.fill_null(_MOST).to_numpy(zero_copy_only=False), np.int64)


@dataclass(frozen=True)
class Rotation:
    """An orthogonal matrix with the leading directions first, and the numbers of components after which bounds are taken."""

    matrix: np.ndarray

    @property
    def steps(self) -> list[int]:
        dim = self.matrix.shape[1]
        return sorted({max(1, dim * s // 4) for s in (1, 2, 3, 4)})

    def turn(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x rotated, and the norm of what lies beyond each of the steps; the last one is 0."""
        y = x.astype(float) @ self.matrix
        beyond = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
        rest = [np.sqrt(beyond[:, s]) if s < y.shape[1] else np.zeros(len(y)) for s in self.steps]
        return y, np.stack(rest, axis=1)


def fit_rotation(rows: DataFrame, dim: int) -> Rotation:
    """The principal directions of all rows(x) by MLlib's PCA; with fewer than two rows there is nothing to rotate by."""
    if dim < 2 or len(rows.take(2)) < 2:
        return Rotation(np.eye(dim))
    vectors = rows.select(array_to_vector(F.transform("x", lambda c: c.cast("double"))).alias("v"))
    found = PCA(k=dim, inputCol="v", outputCol="w").fit(vectors).pc.toArray()
    exact, _ = np.linalg.qr(found)  # orthogonal to rounding whatever the spectrum is
    return Rotation(exact)


@dataclass(frozen=True)
class Anchors:
    """A block of anchors: rows, labels, vectors, and for each slot (a search of its own) the least and greatest score that counts."""

    row: np.ndarray
    label: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def part(self, at: int, n: int) -> Anchors:
        return Anchors(*[getattr(self, f)[at : at + n] for f in ("row", "label", "x", "low", "high")])


class _Best:
    """The k best of each anchor and slot met so far: score falling, then id."""

    def __init__(self, anchors: Anchors, rotation: Rotation, k: int):
        self.anchors, self.k = anchors, k
        self.y, self.rest = rotation.turn(anchors.x)
        self.norm = np.linalg.norm(self.y, axis=1)
        shape = (*anchors.low.shape, k)
        self.score, self.id, self.row = np.full(shape, _LEAST), np.full(shape, _MOST), np.full(shape, -1)

    def bar(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """The score to reach, and the id to stay under where the score is only reached, not passed."""
        full = self.row[:, slot, -1] >= 0
        low = self.anchors.low[:, slot]
        return np.where(full, np.maximum(self.score[:, slot, -1], low), low), np.where(full, self.id[:, slot, -1], _MOST)

    def wanted(self, product: np.ndarray, slack: np.ndarray, ids: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """The pairs that some slot may take: upper bound over its bar, lower bound not above its greatest score."""
        upper, lower = product + slack, product - slack
        out = np.zeros(alive.shape, bool)
        for slot in range(self.score.shape[1]):
            bar, under = self.bar(slot)
            fits = upper >= bar.astype(float)[:, None]
            if (under < _MOST).any():  # a tie counts by a smaller id only (or an equal one: rows of one id)
                fits &= (upper > bar.astype(float)[:, None] + 0.5) | (ids[None, :] <= under[:, None])
            fits &= lower <= self.anchors.high[:, slot].astype(float)[:, None]
            out |= fits
        return out & alive

    def take(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        n, slots, k = self.score.shape
        for slot in range(slots):
            fits = (score >= self.anchors.low[at, slot]) & (score <= self.anchors.high[at, slot])
            if not fits.any():
                continue
            old = np.repeat(np.arange(n), k)
            a = np.concatenate([old, at[fits]])
            s = np.concatenate([self.score[:, slot].ravel(), score[fits]])
            i = np.concatenate([self.id[:, slot].ravel(), ids[fits]])
            r = np.concatenate([self.row[:, slot].ravel(), rows[fits]])
            order = np.lexsort((r, i, r < 0, -s, a))
            a, s, i, r = a[order], s[order], i[order], r[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            first = place < k
            self.score[:, slot] = s[first].reshape(n, k)
            self.id[:, slot] = i[first].reshape(n, k)
            self.row[:, slot] = r[first].reshape(n, k)

    def meet(self, x: np.ndarray, label: np.ndarray, ids: np.ndarray, rows: np.ndarray, turned: tuple, steps: list[int], same: bool) -> None:
        y, rest = turned
        equal = self.anchors.label[:, None] == label[None, :]
        alive = (equal & (self.anchors.row[:, None] != rows[None, :])) if same else ~equal
        product = np.zeros(alive.shape)
        #: far above what sums of doubles lose, far below 1 for vectors whose scores doubles tell apart
        slack = 1e-11 * np.outer(self.norm, np.linalg.norm(y, axis=1)) + 1e-6
        done = 0
        for step, m in enumerate(steps):
            product += self.y[:, done:m] @ y[:, done:m].T
            done = m
            alive = self.wanted(product, np.outer(self.rest[:, step], rest[:, step]) + slack, ids, alive)
            if alive.sum() * 50 <= alive.size:
                break
        a, b = np.nonzero(alive)
        for p in range(0, len(a), 1 << 16):
            pa_, pb = a[p : p + (1 << 16)], b[p : p + (1 << 16)]
            self.take(pa_, inner(self.anchors.x[pa_], x[pb]), ids[pb], rows[pb])


def _search(shared, k: int, same: bool, rows_at_once: int = 2048, anchors_at_once: int = 512):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, rotation = shared.value
        best = [_Best(anchors.part(at, anchors_at_once), rotation, k) for at in range(0, len(anchors.row), anchors_at_once)]
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                x, ids = _matrix(b.column("x")), _ids(b.column("id"))
                label, rows = b.column("label").to_numpy(), b.column("row").to_numpy()
                turned = rotation.turn(x)
                for own in best:
                    own.meet(x, label, ids, rows, turned, rotation.steps, same)
        for own in best:
            a, slot, place = np.nonzero(own.row >= 0)
            i = own.id[a, slot, place]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own.anchors.row[a]),
                    pa.array(slot.astype(np.int32)),
                    pa.array(own.score[a, slot, place]),
                    pa.array(i, mask=i == _MOST),
                    pa.array(own.row[a, slot, place]),
                ],
                names=["anchor_row", "slot", "score", "id", "row"],
            )

    return found


def top_scores(rows: DataFrame, anchors: Anchors, rotation: Rotation, k: int, same: bool) -> DataFrame:
    """rows(row, id, label, x) -> for each anchor and slot the first k rows of its label (or of others) whose score lies in the
    slot's range, with rank; score falling, ties by id, null last. The anchors are sent to the tasks, which pass all rows once
    and give k answers each for an anchor and slot."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, rotation))
    met = rows.select("row", "id", "label", "x").mapInArrow(_search(shared, k, same), FOUND)
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 8192
) -> DataFrame:
    """rows(vec_id, label, vector) -> for each anchor and positive the hard negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    `anchor` says by vec_id which rows are anchors. An anchor's positives are its first `positives` other rows of its label; a
    positive's hard negatives are the first `negatives` rows of other labels with low% to high% of its score. Scores are
    inner products of floor(256*c), exact (they stop at the ends of long); higher ones first, ties by smaller vec_id.

    Rows with a null label or vector, or null or non-finite entries, take no part. Shorter vectors are filled up with zeros.
    Rows are told apart by themselves: repeated vec_ids and repeated rows are rows of their own, as anchors and as answers; a
    null vec_id is never an anchor and comes last in ties. An empty table has no rows; other columns aren't read.

    Anchors go in blocks of `block` rows (a broadcast of at most that many vectors), each block in two passes over all rows: one
    for positives, one for negatives; what a pass returns doesn't depend on how rows are dealt. No cap on candidates: a pair is
    left out only when partial products over leading components, with the norms of the rest and slack for rounding, show that
    its score can't count; the others are settled by integer products.
    """
    spark = rows.sparkSession
    own = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("vector"))
    own = integers(own.where("label is not null"), "vector").select("id", "label", "x")
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = own.select(F.size("x")).first()
    rotation = fit_rotation(own, size[0] if size else 1)
    chosen = ranked(own.withColumnRenamed("id", "vec_id").where(anchor), [F.col("vec_id"), F.col("row")])
    chosen = materialize(chosen.withColumn("block", F.floor((F.col("rank") - 1) / F.lit(block)).cast("int")), "anchors")
    last = chosen.agg(F.max("block")).first()[0]
    out = []
    for b in range(-1 if last is None else last + 1):
        at = chosen.where(F.col("block") == b).select("row", "vec_id", "label", "x").toArrow()
        one = Anchors(at["row"].to_numpy(), at["label"].to_numpy(), _matrix(at["x"]), np.full((len(at), 1), _LEAST + 1), np.full((len(at), 1), _MOST))
        near = top_scores(own, one, rotation, positives, True).toArrow()  # at most block * positives rows
        place = {r: i for i, r in enumerate(one.row.tolist())}
        lows, highs = np.full((len(at), positives), 1), np.zeros((len(at), positives), np.int64)
        asked = []
        for r, rank, score, i in zip(*[near[c].to_pylist() for c in ("anchor_row", "rank", "score", "id")]):
            lows[place[r], rank - 1], highs[place[r], rank - 1] = -(-low * score // 100), high * score // 100
            asked.append((r, rank - 1, at["vec_id"][place[r]].as_py(), i, score))
        slots = Anchors(one.row, one.label, one.x, lows, highs)
        hard = top_scores(own, slots, rotation, negatives, False)
        asked = spark.createDataFrame(asked, "anchor_row long, slot int, anchor_id long, positive_id long, positive_score long")
        path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
        answers = hard.join(F.broadcast(asked), ["anchor_row", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        answers.write.parquet(path)
        out.append(path)
    discard(own, chosen)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*out) if out else spark.createDataFrame([], schema)
