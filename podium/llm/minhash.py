"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from podium.llm.common import WORD, col, materialize, slices, text_buffer
from podium.llm.hashing import LOWER, mix, window_hashes, word_hashes
from podium.llm.near import Sets, similar_classes

_U = np.uint64
BANDS, BAND_ROWS = 32, 4
#: Words of 64 bits of a document's parity sketch.
SKETCH = 32


def shingle_sets(buf: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each row, the sorted distinct hashes of its `width`-word shingles, A-Z lower-cased.

    A row with fewer words has its whole sequence as one shingle; without words, none.
    """
    words, at = word_hashes(LOWER[buf], ends)
    shingles = window_hashes(words, width)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(shingles[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(window_hashes(words[a:b], b - a) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash of non-empty sets, empty bins filled by optimal densification.

    A set's hashes fall into bins by their high bits, each bin keeps its least. An empty bin i copies the bin that the
    universal hash of (i, attempt) names, for the first attempt that names a filled one.
    """
    shift = _U(64 - int(np.log2(bins)))
    out = np.zeros((len(sets), bins), np.uint64)
    filled = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        bin_ = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bin_[1:] != bin_[:-1]]))
        out[i, bin_[first]] = s[first]
        filled[i, bin_[first]] = True
    row, bin_ = np.nonzero(~filled)
    attempt = 0
    while len(row):
        attempt += 1
        source = (mix(bin_.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(attempt)) >> shift).astype(np.int64)
        ok = filled[row, source]
        out[row[ok], bin_[ok]] = out[row[ok], source[ok]]
        row, bin_ = row[~ok], bin_[~ok]
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for k in range(bands):
        h = np.full(len(signature), k + 1, np.uint64)
        for j in range(rows):
            h = mix(h * _U(0x9E3779B97F4A7C15) + signature[:, k * rows + j])
        out[:, k] = h
    return out


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*text_buffer(part.column("text")), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), 2), np.uint64)
                for i in some.tolist():
                    keys[i] = np.add.reduce(sets[i]), np.bitwise_xor.reduce(mix(sets[i]))
                bucket = band_hashes(signatures([sets[i] for i in some], bands * rows), bands, rows)
                lists = np.zeros(len(sets) + 1, np.int32)
                lists[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
                arrays = [part.column("doc_id"), part.column("t"), pa.array(sizes), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(lists), pa.array(bucket.reshape(-1).view(np.int64)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "t", "n_shingles", "key1", "key2", "buckets"])

    return run


def parity_sketch(values: np.ndarray) -> np.ndarray:
    """Bit k of word w: the parity of the distinct values that fall there. As with near.sketch_words, sketches that differ in d
    bits are of sets that differ in d values at least; parities still tell large sets apart."""
    bits = np.bincount((values & _U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*text_buffer(part.column("text")), width)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
                words = pa.array(np.concatenate([*map(parity_sketch, sets), np.zeros(0, np.int64)]))
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), words)
                yield pa.RecordBatch.from_arrays([part.column("t"), pa.ListArray.from_arrays(pa.array(ends), values), words], names=["id", "shingles", "words"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with t, the 64-bit hash that tells texts apart."""
    return docs.withColumn("t", F.xxhash64("text"))


def _rows(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, t, n_shingles, component_id, kept), a row for each row."""
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    signed = docs.mapInArrow(_sign(width, bands, rows), "doc_id long, t long, n_shingles long, key1 long, key2 long, buckets array<long>")
    # the number of a row holds from here on, as it is written
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = signed.where("n_shingles > 0")
    # one row of each distinct set stands for it: the smallest doc_id, null last; the hash of its text is the node
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "row")
    leads = materialize(some.groupBy("key1", "key2").agg(F.min(order).alias("first")).withColumn("id", F.col("first.t")), "leads")
    heads = some.join(leads.select(F.col("first.row").alias("row")), "row", "left_semi")
    buckets = heads.select(F.explode("buckets").alias("bucket"), F.col("t").alias("id"))

    def prepare(ids: DataFrame) -> DataFrame:
        lead = leads.select("id", F.col("first.doc_id").alias("d")).join(ids, "id", "left_semi")
        kept = docs.join(lead, (docs.t == lead.id) & docs.doc_id.eqNullSafe(lead.d), "left_semi").dropDuplicates(["t", "doc_id"])
        return materialize(kept.mapInArrow(_sets(width), "id long, shingles array<long>, words array<long>"), "sets")

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(y, "b").join(x, "a").withColumn("common", F.size(F.array_intersect("x", "y")).cast("long"))
        return both.where(f"100 * common >= {percent} * (size(x) + size(y) - common)").select("a", "b").distinct()

    def sketch(sets: DataFrame) -> DataFrame:
        return sets.select("id", F.size("shingles").cast("long").alias("n"), "words")

    def elements(ids: DataFrame, sets: DataFrame) -> DataFrame:
        return sets.join(ids, "id", "left_semi").select("id", F.explode("shingles").alias("s"))

    found = similar_classes(buckets, prepare, verify, Sets(sketch, elements, percent, SKETCH, parity=True))
    # each linked set with the first row of its component
    linked = leads.join(found.withColumnRenamed("node", "id"), "id").select("key1", "key2", "component", "first")
    linked = linked.join(linked.groupBy("component").agg(F.min("first").alias("top")), "component").select("key1", "key2", "top")
    tops = leads.join(linked, ["key1", "key2"], "left").select("key1", "key2", F.coalesce("top", "first").alias("top"))
    joined = some.join(tops, ["key1", "key2"])
    joined = joined.select("doc_id", "t", "n_shingles", F.col("top.doc_id").alias("component_id"), (F.col("row") == F.col("top.row")).alias("kept"))
    alone = signed.where("n_shingles = 0").select("doc_id", "t", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return joined.unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Two rows are linked if 100 * intersection >= percent * union of their sets of `width`-word shingles (A-Z lower-cased; a
    text with fewer words is one shingle). component_id is the smallest doc_id of the rows reachable, null if all of them are
    null. kept is true for one row of each group: the smallest doc_id, null last, then by text hash. Rows with the same doc_id
    are rows like others. Texts that are null, empty or without words have no shingles and no link, and are kept. Links are
    confirmed on the full sets. Other columns are ignored.

    Equal sets meet by a 128-bit key first, so that copies don't enter the buckets; `bands` buckets of `rows` minima
    (bands * rows a power of two) miss a pair at 85 % with a probability under 1e-10, at 80 % under 1e-7. Texts are told
    apart by a 64-bit hash.
    """
    return _rows(docs, width, percent, bands, rows).drop("t")


def _ordered(kind: DataType) -> bool:
    """Whether Spark can order values of this type."""
    return not any(x in kind.simpleString() for x in ("map<", "variant", "interval"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns. Of rows with equal doc_id and text the one whose other
    columns come first stays; columns without an order, such as maps, don't matter for that."""
    kept = _rows(docs, width, percent, BANDS, BAND_ROWS).where("kept and n_shingles > 0").select(F.col("doc_id").alias("d"), "t")
    with_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    keyed = _keyed(docs.where(with_word))
    # kept rows have distinct (d, t); of rows that are equal in these one stays
    of = keyed.join(kept.withColumnRenamed("t", "kt"), (keyed.t == F.col("kt")) & keyed.doc_id.cast("long").eqNullSafe(F.col("d")), "left_semi")
    order = F.struct(F.lit(0), *[col(f.name) for f in docs.schema if f.name != "text" and _ordered(f.dataType)])
    one = of.groupBy("t", "doc_id").agg(F.min_by(F.struct(*[col(c) for c in docs.columns]), order).alias("row")).select("row.*")
    return one.unionByName(docs.where(~with_word))
