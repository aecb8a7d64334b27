"""Packing token sequences: shortest-pack-first over the length histogram, patterns joined back to pieces by rank."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.llm.common import materialize, slices
from podium.llm.hashing import span_hashes

_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_ODD_PAIRS = ("  ", "\n\n", " \n", "\n ", "<|")
_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A cached piece and its ids take about 300 bytes; a worker keeps so many, unless told otherwise, for its next task.
_CACHE_PIECES = 200_000


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(own))}


class Encoder:
    """ids of texts, as tokenizers gives them for a byte-level BPE without a prefix space.

    Such a tokenizer cuts at single spaces and line ends before it merges, so the ids of a piece (a word with the space
    before it, or a line end) don't depend on its neighbours. Pieces of a slice are told apart by hash and compared byte by
    byte, each new one is encoded once. Texts with other white space, or with what may be a special token's string, are
    encoded whole; so are all texts if the file describes another kind of tokenizer.
    """

    _CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, cached: int = _CACHE_PIECES):
        from tokenizers import Tokenizer

        self._cached = cached
        self._tokenizer = Tokenizer.from_file(path)
        self._letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            self._known = _is_plain(json.load(f))
        self.clear()

    def clear(self) -> None:
        self._place: dict[bytes, int] = {}
        self._words: dict[str, list[int]] = {}
        self._ids = np.zeros(0, np.uint32)
        self._ends = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, word: str) -> list[int]:
        """A word that the tokenizer's pattern doesn't cut."""
        found = self._words.get(word)
        if found is None:
            found = [x.id for x in self._tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self._letters))]
            self._words[word] = found
        return found

    def _learn(self, pieces: list[str]) -> list[list[int]]:
        """Letters up to U+024F are the same in any Unicode version, so those pieces are cut here."""
        odd = [x for x in pieces if max(x) > "\u024f"]
        rest = dict(zip(odd, self._encode(odd), strict=True))
        cut = lambda x: self._merge(x) if x.isalpha() or x[1:].isalpha() and x[0] == " " else list(chain.from_iterable(map(self._merge, self._CUT.findall(x))))
        return [rest[x] if x in rest else cut(x) for x in pieces]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        data = [x.encode() for x in texts]
        buf = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([0, *map(len, data)])
        first = buf == 32
        line = np.flatnonzero(buf == 10)
        first[line] = True
        first[line[line + 1 < len(buf)] + 1] = True
        first[ends[:-1][ends[:-1] < len(buf)]] = True
        start = np.flatnonzero(first)
        stop = np.concatenate([start[1:], [len(buf)]])[: len(start)]
        _, at, inverse = np.unique(span_hashes(buf, start, stop), return_index=True, return_inverse=True)
        length = stop - start
        like = np.repeat(start[at[inverse]] - start, length) + np.arange(len(buf))
        if (length != length[at[inverse]]).any() or (buf[np.minimum(like, len(buf) - 1)] != buf).any():  # two pieces of one hash
            return [np.array(x, np.uint32) for x in self._encode(texts)]
        del like
        raw = buf.tobytes()
        pieces = [raw[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
        known = np.fromiter(map(self._place.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(known < 0).tolist()
        if new:
            got = self._learn([pieces[k].decode() for k in new])
            known[new] = np.arange(len(self._place), len(self._place) + len(new))
            self._place.update((pieces[k], int(known[k])) for k in new)
            self._ids = np.concatenate([self._ids, np.fromiter(chain.from_iterable(got), np.uint32)])
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum([len(x) for x in got])])
        place = known[inverse]
        begin = self._ends[place]
        n = self._ends[place + 1] - begin
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], n)]
        cut = upto[np.searchsorted(start, ends)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i for i, x in enumerate(texts) if not self._known or any(p in x for p in _ODD_PAIRS) or _odd_space(x)}
        if len(self._place) > self._cached:
            self.clear()
        plain = iter(self._plain([x for i, x in enumerate(texts) if i not in odd]))
        whole = iter(self._encode([texts[i] for i in sorted(odd)]))
        return [np.array(next(whole), np.uint32) if i in odd else next(plain) for i in range(len(texts))]


def _is_plain(described: dict) -> bool:
    """Whether a tokenizer file has nothing but byte-level pieces cut by the usual pattern, and a BPE model."""
    cut, model = described.get("pre_tokenizer") or {}, described.get("model") or {}
    special = [x["content"] for x in described.get("added_tokens") or []]
    return (
        cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not described.get("normalizer")
        and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and all("<|" in x for x in special)
    )


def _odd_space(text: str) -> bool:
    """White space other than a space or a line end."""
    if _ODD_BYTE[np.frombuffer(text.encode(), np.uint8)].any():
        return True
    return not text.isascii() and any(c in text for c in _WIDE_SPACES)


@lru_cache(4)
def encoder(path: str, cached: int) -> Encoder:
    return Encoder(path, cached)


def _pieces(tokenizer: str, most: int, end_id: int, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cached)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                texts = [x or "" for x in part.column("text").to_pylist()]
                rows: list[list] = [[], [], [], [], []]
                for i, ids in enumerate(encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    view, n = ids.tobytes(), len(ids)
                    for a in range(0, n, most):
                        b = min(n, a + most)
                        for column, x in zip(rows, (i, a, b - a, zlib.crc32(view[4 * a : 4 * b]), n), strict=True):
                            column.append(x)
                arrays = [part.column("doc_id").take(pa.array(rows[0], pa.int64())), *[pa.array(x, pa.int64()) for x in rows[1:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def patterns(histogram: dict[int, int], most: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of packs, shortest-pack-first: lengths are placed longest first, each into the shortest open packs
    (those with most room); a length that doesn't fit there opens new ones. A pattern's count is split where pieces run
    out, so the work depends on the number of lengths, not of pieces."""
    room: dict[int, list[list]] = defaultdict(list)  # room left -> [count, lengths]
    done: list[tuple[int, list[int]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if length == most:
            done.append((left, [length]))
            continue
        while left:
            pick = max((r for r, packs in room.items() if packs), default=0)
            if pick < length:
                room[most - length].append([left, [length]])
                break
            pack = room[pick][-1]
            n = min(left, pack[0])
            pack[0] -= n
            if not pack[0]:
                room[pick].pop()
            grown = [n, [*pack[1], length]]
            if pick > length:
                room[pick - length].append(grown)
            else:
                done.append((n, grown[1]))
            left -= n
    return done + [(n, lengths) for packs in room.values() for n, lengths in packs]


def _lookup(found: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of its intervals; ranks from 0."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for count, lengths in found:
        offset = 0
        for length in lengths:
            rows[length].append((used[length], base, offset))
            used[length] += count
            offset += length
        base += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}  # type: ignore[misc]


def _place(table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                first, base, off = table[n]
                k = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = base[k] + rank[own] - first[k]
                offset[own] = off[k]
            out = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 0, cached: int = _CACHE_PIECES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    A document's ids are those of the tokenizer file (without special tokens), then end_id; null text is empty. They are
    cut into pieces of `most` and a rest. The histogram of piece lengths (at most `most` numbers) gives the packing
    patterns; pieces of a length are ranked - within hash slots, then by the slots' counts - and the rank names the
    sequence and the offset. Sequences are numbered from 0 and filled without gaps from offset 0. Repeated rows and equal
    or null doc_ids are packed each for itself; other columns are ignored. An empty table gives no pieces. A worker keeps
    the ids of about `cached` pieces of text from task to task: time for memory, the result is the same.
    """
    slots = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = cut.mapInArrow(_pieces(tokenizer, most, end_id, cached), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    cut = materialize(cut.withColumn("slot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slots))), "pieces")
    counts = materialize(cut.groupBy("length", "slot").agg(F.count("*").alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `most` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "slot", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    placed = cut.withColumn("own", own).join(counts, ["length", "slot"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    table = _lookup(patterns(histogram, most))
    return placed.mapInArrow(_place(table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
