"""Document likelihood by a subword lattice: pieces of an existing vocabulary, weighted by what training text uses of them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from podium.llm.common import discard, materialize, slices, text_buffer
from podium.llm.hashing import LOWER
from podium.llm.lattice import Pieces, log_sums

#: Words up to so many bytes are joined as they are, longer ones by their SHA-256, so that a word's key is short.
_KEY_BYTES = 64


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model, best scores first, as bytes: its mark of a word's start is a space, byte pieces are
    bytes. Control pieces and pieces across words go. All 256 bytes are there, so every word has a segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {bytes([b]): -math.inf for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        piece = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
        score = -math.inf if model.is_byte(i) else model.get_score(i)
        if b" " not in piece[1:] and piece:
            best[piece] = max(best.get(piece, -math.inf), score)
    return sorted(best, key=lambda p: (-best[p], p))


def held_out(doc_id: Column, parts: int = 10) -> Column:
    """Whether crc32 of the id as text leaves 0 on division by `parts`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def _split(b: pa.RecordBatch | pa.Table) -> pa.Table:
    """A slice of texts -> its lower-cased words, one row each, and the row of the slice that each stands in (at)."""
    data, ends = text_buffer(b.column("text"))  # copied to begin at 0: split_pattern_regex misreads arrays with an offset
    text = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(ends.tobytes()), pa.py_buffer(LOWER[data].tobytes()))
    words = pc.split_pattern_regex(text, r"[\x20\x09-\x0D]+")
    each = pa.table({"at": pc.list_parent_indices(words), "word": pc.list_flatten(words).cast(pa.string())})
    return each.filter(pc.not_equal(each["word"], ""))


def _counts(rows: DataFrame) -> DataFrame:
    """rows(train, text) -> (word, c, met): counts of words in training rows and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                each = _split(b)
                train = b.column("train").take(each["at"].combine_chunks()).cast(pa.int64())
                own = pa.table({"word": each["word"], "c": train}).group_by("word").aggregate([("c", "sum"), ("c", "count")])
                out = pa.table({"word": own["word"], "c": own["c_sum"], "met": own["c_count"]})
                yield from out.to_batches(max_chunksize=100_000)

    own = rows.select("train", "text").mapInArrow(count, "word string, c long, met long")
    return own.groupBy("word").agg(F.sum("c").alias("c"), F.sum("met").alias("met"))


def _key(word: str) -> Column:
    """A tab can't be in a word, so long words' keys are no words."""
    return F.when(F.octet_length(word) <= _KEY_BYTES, F.col(word)).otherwise(F.concat(F.lit("\t"), F.sha2(F.col(word).cast("binary"), 256)))


def _keys(words: pa.Array) -> pa.Array:
    """The same in Arrow."""
    long = pc.greater(pc.binary_length(words), _KEY_BYTES)
    if not pc.any(long).as_py():
        return words
    return pa.array([("\t" + hashlib.sha256(w.encode()).hexdigest()) if far else w for w, far in zip(words.to_pylist(), long.to_pylist())], pa.string())


def _summands(rows: DataFrame, often: pa.Table, end: tuple[float, float], end_seen: bool) -> DataFrame:
    """rows(row, doc_id, held_out, text) -> for each text one row with the sums over its end and its frequent words, and one for
    each of its other words, with the key to look it up by. Keys of the former are no word's and differ."""
    sent = rows.sparkSession.sparkContext.broadcast(often)
    fields = [StructField("row", LongType()), rows.schema["doc_id"], rows.schema["held_out"], StructField("key", StringType())]
    fields = [StructField(f.name, f.dataType) for f in fields]
    schema = StructType([*fields, StructField("n", LongType()), StructField("seen", LongType()), StructField("base", DoubleType()), StructField("own", DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen, base, own = [sent.value[c].combine_chunks() for c in ("key", "known", "base", "own")]
        seen, base, own = seen.to_numpy(zero_copy_only=False).astype(float), base.to_numpy(), own.to_numpy()
        for whole in batches:
            for b in slices(whole, "text"):
                each = _split(b)
                at = each["at"].to_numpy()
                key = _keys(each["word"].combine_chunks())
                place = pc.index_in(key, keys).fill_null(-1).to_numpy()
                hit = place >= 0
                a, w = at[hit], place[hit]
                total = lambda values, start: start + np.bincount(a, values[w], b.num_rows)  # noqa: B023, E731
                row = b.column("row")
                sums = pa.table(
                    {
                        "row": row,
                        "doc_id": b.column("doc_id"),
                        "held_out": b.column("held_out"),
                        "key": pc.binary_join_element_wise("\t", row.cast(pa.string()), ""),
                        "n": pa.array(1 + np.bincount(a, minlength=b.num_rows)),
                        "seen": pa.array(total(seen, float(end_seen)).astype(np.int64)),
                        "base": pa.array(total(base, end[0])),
                        "own": pa.array(total(own, end[1])),
                    }
                )
                rest = pa.table({"at": at[~hit], "key": key.filter(pa.array(~hit))}).group_by(["at", "key"]).aggregate([([], "count_all")])
                none = pa.nulls(rest.num_rows)
                others = {"row": row.take(rest["at"].combine_chunks()), "key": rest["key"], "n": rest["count_all"].cast(pa.int64())}
                for out in (sums, pa.table({f.name: others.get(f.name, none) for f in schema})):
                    yield from out.cast(to_arrow_schema(schema)).to_batches(max_chunksize=100_000)

    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(add, schema)


@dataclass(frozen=True)
class Model:
    """Counts of the training tokens (a document's end among them) and the log weights of pieces, the end's last."""

    tokens: int
    types: int
    ends: int
    discount: float
    weight: np.ndarray

    def base(self, count: Column) -> Column:
        return F.log10((count + F.lit(0.1)) / F.lit(self.tokens + 0.1 * (self.types + 1)))

    @property
    def rest(self) -> float:
        """What the discounts leave to the lattice."""
        return self.discount * self.types / self.tokens if self.tokens else 1.0

    def end(self) -> tuple[float, float]:
        """base and own score of a document's end."""
        own = max(self.ends - self.discount, 0.0) / max(1, self.tokens) + self.rest * math.exp(self.weight[-1])
        return math.log10((self.ends + 0.1) / (self.tokens + 0.1 * (self.types + 1))), math.log10(own)

    def whole(self, count: Column) -> Column:
        """A word's probability: its discounted share, and the lattice's sum for the rest."""
        share = F.greatest(count - F.lit(self.discount), F.lit(0.0)) / F.lit(float(max(1, self.tokens)))
        # in logs, since a long word's sum is under the least double
        a, b = F.log10(share), F.lit(math.log10(self.rest)) + F.col("lattice")
        most = F.greatest(a, b)
        return F.when(share <= 0, b).otherwise(most + F.log10(F.pow(F.lit(10.0), a - most) + F.pow(F.lit(10.0), b - most)))


def _batch_sums(pieces: Pieces, weight: np.ndarray, words: pa.Array, counts: np.ndarray | None = None) -> np.ndarray:
    return log_sums([b" " + w for w in words.cast(pa.binary()).to_pylist()], pieces, weight[:-1], counts)


def fit_weights(vocabulary: DataFrame, pieces: list[bytes], end_seen: bool, rounds: int = 4) -> np.ndarray:
    """vocabulary(word) -> log weights of pieces, and of the end of a document last.

    They start from the order of the existing scores (a piece's weight falls with its rank) and are estimated anew `rounds`
    times: each distinct word is segmented in all ways, and a piece's weight is the expected number of times it is used, plus
    0.1. Distinct words count once, since the lattice stands for words not seen yet. All words are used, by tasks; the driver
    holds one number for each piece of the vocabulary.
    """
    spark = vocabulary.sparkSession
    start = 1.0 / (10.0 + np.arange(len(pieces) + 1))
    weight = np.log(start / start.sum())
    sent = spark.sparkContext.broadcast(Pieces(pieces))
    for _ in range(rounds):

        def expected(batches: Iterator[pa.RecordBatch], now=spark.sparkContext.broadcast(weight)) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(sent.value.size)
            for whole in batches:
                for b in slices(whole, "word"):
                    _batch_sums(sent.value, now.value, b.column("word"), counts)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["piece", "uses"])

        own = vocabulary.select("word").mapInArrow(expected, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.full(len(pieces) + 1, 0.1)
        uses[-1] += end_seen
        for r in own.collect():
            uses[r.piece] += r.uses
        weight = np.log(uses / uses.sum())
    return weight


def _lattice(words: DataFrame, pieces: list[bytes], weight: np.ndarray) -> DataFrame:
    """words(word, ...) -> with lattice, the log10 of the word's sum over all segmentations."""
    sent = words.sparkSession.sparkContext.broadcast((Pieces(pieces), weight))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "word"):
                found = _batch_sums(*sent.value, b.column("word")) / math.log(10.0)
                yield b.append_column("lattice", pa.array(found))

    return words.mapInArrow(sums, StructType([*words.schema.fields, StructField("lattice", DoubleType())]))


def score_documents(docs: DataFrame, pieces: list[bytes], parts: int = 10, rounds: int = 4, frequent: int = 20_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words, A-Z lower-cased, and one end. Rows that are not held out teach: counts of words, and by them
    the weights of the vocabulary's pieces. `score` is the log10 probability of the text: a word is a space and its bytes; its
    probability is the sum over all segmentations into pieces of the products of their weights, where a word of the training
    text is one more piece of its own, weighted by its count less an absolute discount, and the lattice shares what the
    discounts leave. All weights of what may follow add up to 1 at most, so scores of different texts compare. `base_score`
    takes words as units, add-0.1.

    A null text is empty: its end alone is scored. A null doc_id is held out; repeated rows and ids are rows of their own,
    counted and scored each. Very long texts are split in slices of words, very long words summed alone, at a few bytes of
    memory for each of theirs. Without training rows the existing order of pieces alone decides. An empty table stays empty.

    Each distinct word is summed once, however often it occurs. The `frequent` most frequent words (each by a key of at most 65
    bytes) are sent to all tasks; the others meet their scores in a join, of which no key has more than a `frequent`-th part of
    all tokens.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id"), parts).alias("held_out"), F.col("text").alias("text")
    ).withColumn("train", ~F.col("held_out"))
    counted = materialize(_counts(rows), "words")
    known = counted.where("c > 0")
    ends = rows.where("train").count()
    sums = known.agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("int")).alias("one"), F.sum((F.col("c") == 2).cast("int")).alias("two")).first()
    one, two = (sums.one or 0) + (ends == 1), (sums.two or 0) + (ends == 2)
    discount = one / (one + 2 * two) if one and two else 0.5
    weight = fit_weights(known, pieces, ends > 0, rounds if sums.c else 0)
    model = Model((sums.c or 0) + ends, sums.v + (ends > 0), ends, discount, weight)
    scored = _lattice(counted, pieces, weight).select(
        _key("word").alias("key"), "met", (F.col("c") > 0).alias("known"), model.base(F.col("c")).alias("base"), model.whole(F.col("c")).alias("own")
    )
    scored = materialize(scored, "scores")
    discard(counted)
    often = scored.orderBy(F.desc("met"), "key").limit(frequent).select("key", "known", "base", "own").toArrow()
    table = scored.select("key", "known", F.col("base").alias("__base"), F.col("own").alias("__own"))
    met = _summands(rows, often, model.end(), ends > 0).join(table, "key", "left")
    n, looked_up = F.col("n"), F.col("known").isNotNull()
    summed = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.when(looked_up, F.when(F.col("known"), n).otherwise(0)).otherwise(F.col("seen"))).alias("n_known"),
        F.sum(F.when(looked_up, n * F.col("__base")).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(looked_up, n * F.col("__own")).otherwise(F.col("own"))).alias("score"),
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
