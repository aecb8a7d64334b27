"""Line dedup by MinHash: fuzzy lines share a component of links with exact Jaccard similarity; one line of each stays.

DataFrame functions only. Character shingles are substrings of the line as UTF-32, so that each costs the same.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import col, materialize
from podium.llm.near import Sets, Signed, similar_classes, sketch_words

#: Shingles of a row while minima are taken: a row is looked up by its line's id once for all of them.
AT_ONCE = 8
#: Words of 64 bits of a line's sketch. Fewer are full at some hundred characters and then tell no lines apart.
SKETCH = 32


@dataclass(frozen=True)
class Fuzzy:
    """shingle: characters of a shingle. percent: least 100 * intersection / union. minima: of a signature, and as many bands
    of five of them. Two lines at 80 % share no band with a probability of about 5e-5 (simulated), whatever their length. Lines that
    have a phrase or two in common hardly ever share five minima; with bands of three or four such pairs grow with the square of the lines.

    Minima are over all shingles of every line that isn't blank, so lines with equal sets share all bands.
    """

    shingle: int = 7
    percent: int = 80
    minima: int = 48
    seed: int = 11

    def __post_init__(self):
        if self.minima < 23:
            raise ValueError("bands of fewer minima share more than one of them")
        if -(-self.minima // 2) % 7 == 0:
            raise ValueError("some orders would be turned alike")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _wide(line: Column) -> Column:
    return F.encode(line, "utf-32")


def _order(s: Column, turn: int, mask: int) -> Column:
    """One of the orders of a 32-bit hash: its bits rotated, then some of them flipped."""
    turned = F.shiftleft(s, turn).bitwiseOR(F.shiftrightunsigned(s, 32 - turn)) if turn else s
    return turned.bitwiseXOR(F.lit(mask))


def _shingles(lines: DataFrame, size: int) -> DataFrame:
    """lines(id, line) -> (id, s): the hash of each shingle, repeats too."""
    wide = lines.select("id", _wide(F.col("line")).alias("wide"))
    last = F.greatest(F.lit(1), F.length("wide") - (4 * size - 1))
    each = wide.select("id", "wide", F.explode(F.sequence(F.lit(1), last, F.lit(4))).alias("at"))
    return each.select("id", F.xxhash64(F.substring(F.col("wide"), F.col("at"), F.lit(4 * size))).alias("s"))


def _shingle_rows(lines: DataFrame, size: int) -> DataFrame:
    """lines(id, line) -> (id, s0, s1, ...): the hashes of consecutive shingles; the last one fills up its row."""
    wide = lines.select("id", _wide(F.col("line")).alias("wide"))
    last = F.greatest(F.lit(1), F.length("wide") - (4 * size - 1))
    each = wide.select("id", "wide", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(4 * AT_ONCE))).alias("at"))
    at = [F.least(F.col("at") + 4 * j, F.col("last")) for j in range(AT_ONCE)]
    return each.select("id", *[F.xxhash64(F.substring(F.col("wide"), a, F.lit(4 * size))).alias(f"s{j}") for j, a in enumerate(at)])


def line_signatures(lines: DataFrame, how: Fuzzy) -> Signed:
    """lines(id, line) -> the minima of each distinct line, and the bands made of them.

    Minima are taken where lines lie, and those of repeated lines put together by id, so minima are dealt in place of texts. They are
    of the halves of 64-bit hashes in turn: chance makes two of four bytes equal in one of 2**32. A band is five minima, any two
    bands share one at most. A line shorter than a shingle is similar to equal lines only, and those have one id already.
    """
    rng, turns = random.Random(how.seed), -(-how.minima // 2)
    # seven turns on each time: the orders of a band lie far apart, or few shingles would come first in several of them together
    orders = [(i % 2, 32 * (7 * (i // 2) % turns) // turns, rng.getrandbits(32) - (1 << 31)) for i in range(how.minima)]
    each = _shingle_rows(lines.where(F.length("line") >= how.shingle), how.shingle)
    half = (lambda s: F.shiftright(s, 32), lambda s: F.shiftright(F.shiftleft(s, 32), 32))
    each = each.select("id", *[h(F.col(f"s{j}")).cast("int").alias(f"h{k}_{j}") for k, h in enumerate(half) for j in range(AT_ONCE)])
    least = [F.least(*[_order(F.col(f"h{k}_{j}"), turn, mask) for j in range(AT_ONCE)]) for k, turn, mask in orders]
    signed = each.groupBy("id").agg(*[F.min(x).alias(f"m{i}") for i, x in enumerate(least)])
    return Signed(signed, [F.xxhash64(F.lit(i), *[f"m{(i + j) % how.minima}" for j in (0, 1, 4, 9, 11)]) for i in range(how.minima)])


def line_buckets(lines: DataFrame, how: Fuzzy) -> DataFrame:
    """lines(id, line) -> (bucket, id): the bands of each distinct line."""
    return line_signatures(lines, how).dealt()


def line_sketches(lines: DataFrame, how: Fuzzy) -> DataFrame:
    """lines(id, line), distinct -> (id, n, words): as near.Sets has it; n counts repeats too. A shingle sets a bit of one word, so four words are
    made for each row and lie side by side after that."""
    s = F.col("s")
    four = F.shiftrightunsigned(s, 8).bitwiseAND(F.lit(SKETCH // 4 - 1)).cast("int")
    each = _shingles(lines.repartition("id"), how.shingle).select("id", "s", four.alias("four"))
    rows = each.groupBy("id", "four").agg(F.count("*").alias("k"), *[w.alias(f"w{i}") for i, w in enumerate(sketch_words(s, 4))])
    words = [F.coalesce(F.max(F.when(F.col("four") == w // 4, F.col(f"w{w % 4}"))), F.lit(0).cast("long")) for w in range(SKETCH)]
    return rows.groupBy("id").agg(F.sum("k").alias("n"), F.array(*words).alias("words"))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once: a column inside a lambda would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _set(line: Column, size: int) -> Column:
    """The distinct shingles of a line, as hashes."""
    at = lambda w: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (4 * size - 1)), F.lit(4))
    return _bound(_wide(line), lambda w: F.array_distinct(F.transform(at(w), lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * size))))))


def _similar(x: Column, y: Column, percent: int) -> Column:
    """Whether two sets have the similarity: sizes first, then their common shingles."""

    def judge(p: Column) -> Column:
        a, b = F.size(p["x"]), F.size(p["y"])
        fits = F.least(a, b) * 100 >= F.greatest(a, b) * percent
        return fits & _bound(F.size(F.array_intersect(p["x"], p["y"])), lambda c: c * 100 >= (a + b - c) * percent)

    return _bound(F.struct(x.alias("x"), y.alias("y")), judge)


def fuzzy_classes(lines: DataFrame, how: Fuzzy) -> DataFrame:
    """lines(id, line) -> (node, component) of the lines that are linked to another line."""

    def prepare(ids: DataFrame) -> DataFrame:
        return materialize(lines.join(ids, "id", "left_semi").dropDuplicates(["id"]), "lines")

    def verify(pairs: DataFrame, kept: DataFrame) -> DataFrame:
        x = kept.select(F.col("id").alias("a"), F.col("line").alias("x"))
        y = kept.select(F.col("id").alias("b"), F.col("line").alias("y"))
        same = _similar(_set(F.col("x"), how.shingle), _set(F.col("y"), how.shingle), how.percent)
        return pairs.join(y, "b").join(x, "a").where(same).select("a", "b")

    def elements(ids: DataFrame, kept: DataFrame) -> DataFrame:
        return kept.join(ids, "id", "left_semi").select("id", F.explode(_set(F.col("line"), how.shingle)).alias("s"))

    def sketch(kept: DataFrame) -> DataFrame:
        return line_sketches(kept, how)

    return similar_classes(line_signatures(lines, how), prepare, verify, Sets(sketch, elements, how.percent, SKETCH, exact=False))


def dedup_lines(docs: DataFrame, how: Fuzzy | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> the rows of docs, text without repeated lines, with n_lines and n_removed.

    Lines end at \\n and are compared without white space at their ends. Two lines are linked if their sets of character
    shingles have the given similarity (equal lines always do); of each component the line that comes first by doc_id
    (null last), text hash and place stays, the others go with their line end. Blank lines are left alone. A null text stays
    null and has no lines; an empty text has one. Rows with equal doc_id and text count as one document and come out alike, so
    repeated rows keep the same lines. An empty table stays empty. Other columns stay as they are, whatever their names;
    columns named n_lines or n_removed are replaced. Lines are told apart by a 64-bit hash.
    """
    how = how or Fuzzy()
    docs = docs.drop("n_lines", "n_removed")
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*[col(c) for c in others]).alias("row"), F.col("doc_id").cast("long").alias("d"), "text", F.xxhash64("text").alias("t"))
    each = keyed.select("d", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", _trimmed(F.col("line")))
    each = each.where(F.length("line") > 0).withColumn("id", F.xxhash64("line"))
    found = fuzzy_classes(each.select("id", "line"), how).withColumnRenamed("node", "id")
    of = each.select("d", "t", "pos", "id").join(found, "id", "left").select("d", "t", "pos", F.coalesce("component", "id").alias("c"))
    of = materialize(of, "places")
    first = of.groupBy("c").agg(F.min(F.struct(F.col("d").isNull().alias("n"), "d", "t", "pos")).alias("f"), F.count("*").alias("many"))
    again = of.join(first.where("many > 1").select("c", "f"), "c").where("not (d <=> f.d and t = f.t and pos = f.pos)")
    gone = again.groupBy("d", "t").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("d").alias("gd"), F.col("t").alias("gt"), "gone")
    joined = keyed.join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("t") == F.col("gt")), "left")
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_bound(parts, lambda p: F.transform(stay, lambda i: F.element_at(p, i + 1))), "\n"))
    n_lines = F.coalesce(F.size(parts), F.lit(0))
    out = joined.select("row", text.alias("text"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"))
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, "n_lines", "n_removed")
