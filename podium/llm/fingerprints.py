"""Order MinHash fingerprints of documents, and their likeness to an edited text and to the next document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import slices
from podium.llm.hashing import mix

_U = np.uint64
K, SAMPLES, LENGTH = 6, 128, 2
#: k-mers that meet all orders at once.
_CHUNK = 2_048
#: An order ranks 32-bit k-mer hashes by their product with one of these odd numbers.
_ORDERS = (mix(np.arange(1, 4097, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_LAST = np.uint32(0xFFFFFFFF)


def order_minhash(text: str, k: int = K, samples: int = SAMPLES, length: int = LENGTH) -> np.ndarray:
    """The order MinHash signature of a text: `samples` 16-bit hashes.

    Every k-mer of code points gets its occurrence number among equal k-mers and a 64-bit hash of both. Each signature entry has
    an order of its own: it takes the `length` k-mers that come first in it, puts them in text order and hashes that tuple.
    k-mers that are equal in an order (32 bits) come in text order. A text shorter than k is one k-mer; an empty one has a
    constant signature that only equals itself.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(code):
        return np.zeros(samples, np.uint16)
    n = max(1, len(code) - k + 1)
    kmer = np.zeros(n, np.uint64)
    for j in range(min(k, len(code))):
        kmer = kmer * _U(0x9E3779B97F4A7C15) + code[j : j + n] + _U(1)
    # occurrence numbers: equal k-mers stand together, in text order
    kmer = mix(kmer)
    order = np.argsort(kmer, kind="stable")
    head = kmer[order]
    index = np.arange(n)
    number = index - np.maximum.accumulate(np.where(np.concatenate([[True], head[1:] != head[:-1]]), index, 0))
    hashes = np.empty(n, np.uint64)
    hashes[order] = mix(head + number.astype(np.uint64))
    picked = np.sort(first_places((hashes >> _U(32)).astype(np.uint32), samples, length), axis=1)
    out = np.full(samples, picked.shape[1], np.uint64)
    for j in range(picked.shape[1]):
        out = mix(out * _U(0xD6E8FEB86659FD93) + hashes[picked[:, j]])
    return np.maximum(out >> _U(48), _U(1)).astype(np.uint16)


def first_places(values: np.ndarray, samples: int, length: int) -> np.ndarray:
    """For each order, the places of the `length` values that come first in it (all, if there are fewer)."""
    every = np.arange(samples)[:, None]
    take = min(length, len(values))
    rank, place = np.zeros((samples, 0), np.uint32), np.zeros((samples, 0), np.int64)
    for a in range(0, len(values), _CHUNK):
        ranks = values[None, a : a + _CHUNK] * _ORDERS[:samples, None]
        np.minimum(ranks, _LAST - np.uint32(1), out=ranks)
        own, at = [rank], [place]
        for _ in range(min(take, ranks.shape[1])):
            least = ranks.argmin(1)[:, None]
            own.append(np.take_along_axis(ranks, least, 1))
            at.append(least + a)
            ranks[every, least] = _LAST
        rank, place = np.concatenate(own, 1), np.concatenate(at, 1)
        if rank.shape[1] > take:
            keep = np.argsort(rank, axis=1, kind="stable")[:, :take]
            rank, place = np.take_along_axis(rank, keep, 1), np.take_along_axis(place, keep, 1)
    return place


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def _text(value: str | None) -> str:
    return value or ""


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, then in document order; a row marked `extra` only serves as the next one."""
    before: tuple | None = None  # (part, doc_id, text, fingerprint)

    def line(own: tuple, text: str, print_: np.ndarray) -> tuple:
        n = len(own[2])
        cut = n // 3
        edited = own[2][: n - cut] + text[:cut]
        other = order_minhash(edited) if cut else own[3]
        data = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return own[1], n, data, own[3].astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(own[3], other), likeness(own[3], print_)

    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            columns = [part.column(c).to_pylist() for c in ("part", "doc_id", "text", "extra")]
            for p, doc, text, extra in zip(*columns, strict=True):
                text = _text(text)
                if extra and (before is None or before[0] != p):
                    continue  # a second row with the next part's first doc_id
                print_ = order_minhash(text)
                if before is not None and before[0] == p:
                    out.append(line(before, text, print_))
                before = None if extra else (p, doc, text, print_)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=_SCHEMA) if out else pa.RecordBatch.from_pylist([], schema=_SCHEMA)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _above(key: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds lie above the key: first in steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    cuts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    many = lambda values: F.size(F.filter(values, lambda b: b > key))
    whole = many(F.lit([c[-1] for c in cuts]))
    return whole * step + F.coalesce(many(F.get(F.lit(cuts), whole)), F.lit(0))


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one with the next smaller doc_id; after the last comes the first. The edited text is the
    text with its last n_chars // 3 code points replaced by as many (or all) first ones of the next document. near_*:
    share of equal signature entries. Null texts are empty; null doc_ids come after all others; rows with the same doc_id
    follow each other in byte order of their texts. A single document is its own next. Other columns are ignored.

    Documents are dealt into ranges of doc_id; each range is read in order, and the first document of the following
    range is sent to it as well, so every text is shuffled once. The driver gets one number for each range.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)  # at most `parts`
    # part 0 has the largest ids; an id equal to a bound belongs above it; null ids are in the last part
    rows = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(_above(F.col("doc_id"), bounds)).cast("int"))
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("part").agg(F.max("doc_id")).collect())  # a row for each part
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # the first id of each part goes to the part before it too: a table of one row for each part
    heads = spark.createDataFrame([(firsts[(i + 1) % len(firsts)][1], p) for i, (p, _) in enumerate(firsts)], "head long, to int")
    rows = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    copies = F.array_compact(F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(True).alias("extra")))))
    rows = rows.select("doc_id", "text", F.explode(copies).alias("at")).select("doc_id", "text", "at.*")
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.select("part", "doc_id", "text", "extra").mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
