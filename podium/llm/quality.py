"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks, with limits by length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import col, slices, text_buffer
from podium.llm.hashing import IS_SPACE, mix, window_hashes, word_hashes

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size by length in bytes, read off between the knots on a scale of log length.

    whole_low, whole_high: of the whole text. A text of at least two chunks is cut into chunks of `chunk_bytes` bytes, the last
    one being its last `chunk_bytes` bytes, so that nothing is left out; it goes if more than `chunk_share` of them lie below
    chunk_low (repetitive) or above chunk_high (incompressible). Texts shorter than knots[0] have no band: a frame header
    outweighs what they hold. The lower limits lie 0.005 to 0.02 under the least ratio of 3,400 texts labelled as good, the
    upper ones at least 0.08 above the greatest.
    """

    knots: tuple[int, ...] = (300, 500, 750, 1_000, 1_500, 2_500, 4_000, 7_000, 12_000, 20_000, 40_000, 100_000, 1_000_000)
    whole_low: tuple[float, ...] = (0.515, 0.51, 0.5, 0.482, 0.462, 0.442, 0.428, 0.412, 0.4, 0.392, 0.38, 0.35, 0.3)
    whole_high: tuple[float, ...] = (0.88, 0.84, 0.8, 0.76, 0.72, 0.68, 0.64, 0.62, 0.6, 0.58, 0.56, 0.55, 0.55)
    chunk_bytes: int = 2_000
    chunk_low: float = 0.455
    chunk_high: float = 0.75
    chunk_share: float = 0.5
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


_ADDED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, "
    "chunks_low double, chunks_high double, base_failed boolean, kept boolean"
)


def _dup_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if not text or "\n" not in text:
        return 0
    seen: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    seen.update(lines)
    return len(lines) - len(seen)


def repeat_words(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row, its words that lie in a 3-word window found twice or more in that row."""
    n = len(words)
    counts = np.zeros(n + 1, np.int64)
    if n >= 3:
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        key = window_hashes(words, 3)
        inside = row[2:] == row[:-2]
        place = np.flatnonzero(inside)
        key = key[place] ^ mix(row[place].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(place), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = place[order[again]]
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[hit + k] = True
        counts[1:] = np.cumsum(covered)
    return counts[at[1:]] - counts[at[:-1]]


def compression(buf: np.ndarray, ends: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the ratio of the whole text, and the shares of chunks below and above the chunk limits."""
    pack = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
    whole, low, high = (np.zeros(len(ends) - 1) for _ in range(3))
    view = memoryview(np.ascontiguousarray(buf))
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if b - a < bands.knots[0]:
            whole[i] = np.nan
            continue
        whole[i] = len(pack.compress(view[a:b])) / (b - a)
        size = bands.chunk_bytes
        if b - a >= 2 * size:
            each = [len(pack.compress(view[x : x + size])) / size for x in {*range(a, b - size + 1, size), b - size}]
            low[i] = sum(x < bands.chunk_low for x in each) / len(each)
            high[i] = sum(x > bands.chunk_high for x in each) / len(each)
    return whole, low, high


def band_verdict(n_bytes: np.ndarray, whole: np.ndarray, low: np.ndarray, high: np.ndarray, bands: Bands) -> np.ndarray:
    """True where a text lies within the limits of its length."""
    at, knots = np.log(np.maximum(n_bytes, 1)), np.log(bands.knots)
    bad = (whole < np.interp(at, knots, bands.whole_low)) | (whole > np.interp(at, knots, bands.whole_high))
    return (n_bytes < bands.knots[0]) | ~(bad | (low > bands.chunk_share) | (high > bands.chunk_share))


def score_quality(docs: DataFrame, text: str = "text", bands: Bands | None = None) -> DataFrame:
    """The rows of docs with counts, ratios and a verdict; every column of docs stays.

    Added: n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words, zstd_ratio (null for
    texts too short for a band), chunks_low, chunks_high (shares), base_failed, kept. Words are runs of characters
    other than space and \\t..\\r. A null or empty text has no words and fails the base rules. Input columns with the
    name of an added one are replaced. Repeated rows are judged alike; row order doesn't matter.
    """
    bands = bands or Bands()
    names = [x.split()[0] for x in _ADDED.split(", ")]
    base = docs.drop(*[c for c in names if c != text])
    given = base.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                buf, ends = text_buffer(column)
                words, at = word_hashes(buf, ends)
                n_words = np.diff(at)
                per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[ends])
                chars = per(~IS_SPACE[buf] & ((buf & 0xC0) != 0x80))
                dup = np.fromiter((_dup_lines(x) for x in column.to_pylist()), np.int64, len(column))
                repeat = repeat_words(words, at)
                whole, low, high = compression(buf, ends, bands)
                failed = (n_words < bands.min_words) | (100 * repeat > bands.max_repeat_percent * n_words)
                kept = ~failed & band_verdict(np.diff(ends), whole, low, high, bands)
                added = [n_words, chars, per(_SYMBOL[buf]), dup, repeat]
                out = [part.column(c) for c in given] + [pa.array(x.astype(np.int64)) for x in added]
                out += [pa.array(whole, from_pandas=True), pa.array(low), pa.array(high), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(out, names=[*given, *names])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(judge, f"{fields}, {_ADDED}")


def keep_quality(docs: DataFrame, text: str = "text", bands: Bands | None = None) -> DataFrame:
    """The rows of docs that score_quality keeps, with the columns of docs, whatever their names."""
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    judged = score_quality(plain, f"c{docs.columns.index(text)}", bands).where("kept")
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
