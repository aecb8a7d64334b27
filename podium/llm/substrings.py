"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark by hash range."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import slices, text_buffer
from podium.llm.hashing import window_hashes, word_hashes

_NO_ID = (1 << 63) - 1
_REQUEST = "bucket int, docs array<long>, groups array<int>, counts array<int>, hashes binary, doc long, text_key long, bits binary"
_ANSWER = "grp int, docs array<long>, counts array<int>, hashes binary, doc long, text_key long, bits binary"


def _windows(buf: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows inside a row, the rows and first words they have, and the words' offsets."""
    words, at = word_hashes(buf, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), at
    place = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1])
    return window_hashes(words, width)[place], row[place], place, at


def _text_keys(buf: np.ndarray, ends: np.ndarray) -> list[int]:
    view = memoryview(np.ascontiguousarray(buf))
    return [
        int.from_bytes(hashlib.blake2b(view[a:b], digest_size=8).digest(), "little", signed=True)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ]


def _ask(width: int, buckets: int):
    """Each hash of a slice once, for the smallest doc_id there; what other documents of the slice repeat is marked
    at once. So a very common window is sent once a slice, not once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("docs", pa.list_(pa.int64())), ("groups", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("hashes", pa.binary()), ("doc", pa.int64()), ("text_key", pa.int64()), ("bits", pa.binary())])
        for batch in batches:
            for part in slices(batch, "text", 10_000_000):
                buf, ends = text_buffer(part.column("text"))
                ids = part.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                group = dict(zip(ids.tolist(), part.column("grp").to_pylist(), strict=True))
                hashes, row, _, _ = _windows(buf, ends, width)
                if not len(hashes):
                    continue
                order = np.argsort(hashes)
                h, doc = hashes[order], ids[row[order]]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                least = np.minimum.reduceat(doc, first)
                local = doc > np.repeat(least, np.diff(np.concatenate([first, [len(h)]])))
                mark = np.zeros(len(hashes), bool)
                mark[order[local]] = True
                h, doc = h[first], least
                del hashes, order, local
                bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((doc, bucket))
                h, doc, bucket = h[order], doc[order], bucket[order]
                rows: list[dict] = []
                cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), [len(h)]])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
                    rows.append({"bucket": int(bucket[a]), "docs": doc[a:b][own], "groups": [group[x] for x in doc[a:b][own].tolist()], "counts": np.diff(np.concatenate([own, [b - a]])), "hashes": h[a:b].tobytes()})
                starts = np.searchsorted(row, np.arange(len(ids) + 1))
                marked = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(mark)])[starts]))
                if len(marked):
                    keys = _text_keys(buf, ends)
                    for i in marked.tolist():
                        rows.append({"bucket": group[int(ids[i])] % buckets, "groups": [group[int(ids[i])]], "doc": int(ids[i]), "text_key": keys[i], "bits": np.packbits(mark[starts[i] : starts[i + 1]]).tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket: the hashes of each document that a document with a smaller doc_id has, a row for each group of
    documents; marks pass through."""
    asked = table.filter(pc.is_valid(table["hashes"]))
    passed = table.filter(pc.is_valid(table["bits"]))
    rows = [{"grp": g[0], "doc": d, "text_key": k, "bits": b} for g, d, k, b in zip(*[passed[c].to_pylist() for c in ("groups", "doc", "text_key", "bits")], strict=True)]
    if asked.num_rows:
        flat = lambda c: asked[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in asked["hashes"].to_pylist()])
        counts = flat("counts")
        doc, group = np.repeat(flat("docs"), counts), np.repeat(flat("groups"), counts)
        order = np.argsort(h)
        h, doc, group = h[order], doc[order], group[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        later = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.concatenate([first, [len(h)]])))
        h, doc, group = h[later], doc[later], group[later]
        order = np.lexsort((doc, group))
        h, doc, group = h[order], doc[order], group[order]
        if len(h):
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True):
                own = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
                rows.append({"grp": int(group[a]), "docs": doc[a:b][own], "counts": np.diff(np.concatenate([own, [b - a]])), "hashes": h[a:b].tobytes()})
    return pa.Table.from_pylist(rows, schema=_ANSWERS)


_ANSWERS = pa.schema([("grp", pa.int32()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("hashes", pa.binary()), ("doc", pa.int64()), ("text_key", pa.int64()), ("bits", pa.binary())])


def _covered(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """The words in maximal intervals: windows that start at `starts`, merged."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def intervals(covered: np.ndarray) -> list[list[int]]:
    """[first word, word after the last] of each maximal run."""
    step = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return step.reshape(-1, 2).tolist()


def _remove(width: int):
    def clean(part: pa.Table, flags: dict[int, np.ndarray], marks: dict[tuple[int, int], np.ndarray]) -> pa.Table:
        buf, ends = text_buffer(part.column("text"))
        ids = part.column("doc_id").fill_null(_NO_ID).to_pylist()
        hashes, row, place, at = _windows(buf, ends, width)
        starts = np.searchsorted(row, np.arange(len(at)))
        keys, view = _text_keys(buf, ends) if marks else None, memoryview(np.ascontiguousarray(buf))
        kept, spans, removed = [], [], []
        for i, doc in enumerate(ids):
            words = bytes(view[ends[i] : ends[i + 1]]).split()
            a, b = starts[i], starts[i + 1]
            found = flags.get(doc)
            hit = np.zeros(b - a, bool) if found is None else np.isin(hashes[a:b], found)
            marked = marks.get((doc, keys[i])) if keys else None
            if marked is not None:
                hit |= np.unpackbits(marked, count=b - a).astype(bool)
            gone = _covered(len(words), place[a:b][hit] - at[i], width) if hit.any() else np.zeros(len(words), bool)
            spans.append(intervals(gone))
            removed.append(int(gone.sum()))
            if removed[-1]:
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept.append(b" ".join(words))
        arrays = [part.column("doc_id").combine_chunks(), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table(arrays, names=["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        lists: dict[int, list[np.ndarray]] = {}
        marks: dict[tuple[int, int], np.ndarray] = {}
        for a in answers.to_pylist():
            if a["bits"] is not None:
                marks[a["doc"], a["text_key"]] = np.frombuffer(a["bits"], np.uint8)
            else:
                cut = np.cumsum([0, *a["counts"]])
                h = np.frombuffer(a["hashes"], np.uint64)
                for k, doc in enumerate(a["docs"]):
                    lists.setdefault(doc, []).append(h[cut[k] : cut[k + 1]])
        flags = {k: np.concatenate(v) for k, v in lists.items()}
        parts = [clean(x, flags, marks) for x in slices(docs.combine_chunks(), "text")]
        return pa.concat_tables(parts) if parts else clean(docs, flags, marks)

    return run


#: Bytes of text that one task of either shuffle holds on average, at most.
BUCKET_BYTES = 16_000_000


def dedup_substrings(docs: DataFrame, width: int = 13, buckets: int | None = None) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, n_words, n_removed, removed, kept_text), a row for each row of docs.

    A window is `width` consecutive words of one text; it goes if its words also start somewhere in a document with a
    smaller doc_id. `removed` has the maximal [from, to) runs of words that go, `kept_text` the others joined by one
    space. Windows are judged on the input. Null or empty texts and those under `width` words lose nothing. Rows with
    the same doc_id don't remove each other's windows; a null doc_id counts as larger than all others. Other columns
    are ignored, an empty table gives no rows. Windows are compared by a 64-bit hash: of n different windows about n / 2^64 are
    taken for another one (5e-7 of 10^13). `buckets` (default: one for BUCKET_BYTES of text, and twice the shuffle partitions at
    least) bounds what one task holds: a range of hashes, then a group of documents. Each slice of the input sends a hash once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not buckets:
        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    docs = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    asked = docs.mapInArrow(_ask(width, buckets), _REQUEST)
    answers = asked.groupBy("bucket").applyInArrow(_answer, _ANSWER)
    out = "doc_id long, n_words long, n_removed long, removed array<array<long>>, kept_text string"
    return docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_remove(width), out)
