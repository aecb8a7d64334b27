"""From banded buckets to verified classes, without all pairs of a bucket.

In buckets of a few rows all meet all, which settles them at once; a row meets few others there, however many such buckets there are.

A larger bucket's smallest member is its hub. Star edges hub - member are checked with those pairs and joined into components. Members whose
component differs from their bucket's main one ("strangers") are then checked against the smallest stranger and the hub of
each of their larger buckets. Pairs within a component need no check: they are linked already. So a group of n near copies costs
about n checks. Where no larger bucket has strangers, as on small tables, nothing follows.

What is still open is settled exactly. Buckets are split by set size where it is known, so that only sets meet whose sizes allow a link. In a
part of at most `most` rows strangers meet the others, which bounds the pairs by `most` for each row; the sets of larger parts
meet by their rarest elements (prefix filter), which loses no link either. Pairs whose sketches or places in the prefixes rule a link
out are left out at each step.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import discard, materialize
from podium.llm.components import components

#: Rows of a bucket in which all meet all.
FEW = 16
#: Words of a short sketch: little code where the same rows meet in many buckets.
SHORT = 8
#: Buckets of an id that are dealt out at a time, where they are made of written rows.
BANDS = 12

#: (pairs(a, b), what prepare made) -> those of them that are similar, (a, b)
Verify = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Sets:
    """What tells pairs that can't be links from those that may be. sketch(store) -> (id, n, words array<long>): a set's size
    (exact, or at least that large) and its sketch. elements(ids, store) -> (id, s): the distinct elements of sets. percent: of
    a link. words: of a sketch. most: rows of a part that are compared with each other. parity: whether a sketch's bits are parities."""

    sketch: Callable[[DataFrame], DataFrame]
    elements: Callable[[DataFrame, DataFrame], DataFrame]
    percent: int
    words: int
    exact: bool = True
    most: int = 200
    parity: bool = False

    def fits(self, words: int | None = None) -> str:
        """Over x and y: two sets whose sketches differ in d bits differ in d elements at least, and the elements in which
        similar sets differ are a bounded share of all. So this never loses a link, whether it takes all words or folded ones."""
        differ = " + ".join(f"bit_count(x.words[{w}] ^ y.words[{w}])" for w in range(words or self.words))
        sizes = f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {self.percent} and " if self.exact else ""
        return f"{sizes}({differ}) * {100 + self.percent} <= {100 - self.percent} * (x.n + y.n)"

    def folded(self, known: DataFrame, words: int) -> DataFrame:
        """known with short sketches that all elements still have a part in: words laid over each other are a sketch of fewer slots."""
        fold = " ^ " if self.parity else " | "
        short = [F.expr(fold.join(f"words[{w}]" for w in range(i, self.words, words))) for i in range(words)]
        return known.select("id", "n", F.array(*short).alias("words"))

    def likely(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be links."""
        x, y = known.select(F.col("id").alias("a"), F.struct("n", "words").alias("x")), known.select(F.col("id").alias("b"), F.struct("n", "words").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(self.fits()).select("a", "b")


@dataclass(frozen=True)
class Signed:
    """rows(id, ...): one for each id, what its buckets are made of. buckets: they, as columns of those."""

    rows: DataFrame
    buckets: list[Column]

    def dealt(self) -> DataFrame:
        """(bucket, id), all of them."""
        return self.rows.select(F.explode(F.array(*self.buckets)).alias("bucket"), "id")


def with_class(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """buckets(bucket, id) -> (bucket, id, hub, m) of the buckets with several ids; hub is the smallest, m counts the rows. One pass
    over the sorted rows: a join with the hubs could make all buckets twice."""
    order = Window.partitionBy("bucket").orderBy("id")
    hub, after = F.first("id").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lead("id").over(order)
    many = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = buckets.select("bucket", "id", hub.alias("hub"), after.alias("after"), many.alias("m"))
    return each.where("id != hub or after != hub").select("bucket", "id", "hub", "m")


def shared_in_turns(signed: Signed) -> list[DataFrame]:
    """The shared buckets, written. Rows are written first and their buckets dealt out a few at a time, so that all of them never lie on
    the disk at once: they take far more room than what they are made of, and than those of them that are shared."""
    rows = materialize(signed.rows, "buckets")
    turns = [Signed(rows, signed.buckets[i : i + BANDS]) for i in range(0, len(signed.buckets), BANDS)]
    met = [materialize(shared_buckets(turn.dealt()), "shared") for turn in turns]
    discard(rows)
    return met


def first_pairs(met: DataFrame, known: DataFrame, sets: Sets) -> DataFrame:
    """Rows (bucket, id, hub, m) of shared buckets -> pairs (a, b), a < b, that may be links, repeats too: all of buckets of a few rows, a star of each
    larger one, in which an id meets the smallest of its hubs."""
    few = min(sets.words, SHORT)
    each = met.where(F.col("m") <= FEW).select("bucket", "id").join(sets.folded(known, few), "id")
    pairs = each.alias("x").join(each.alias("y"), F.expr(f"x.bucket = y.bucket and x.id < y.id and {sets.fits(few)}"))
    star = met.where((F.col("m") > FEW) & (F.col("id") != F.col("hub"))).groupBy("id").agg(F.min("hub").alias("hub"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).unionByName(star.select(F.col("hub").alias("a"), F.col("id").alias("b")))


def open_buckets(met: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of buckets that have several components, with component and the bucket's main one (that of its hub)."""
    rows = with_class(met, found)
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("main"), F.max("component").alias("other")).where("main < other")
    return rows.join(mixed.select("bucket", "main"), "bucket")


def sketch_words(element: Column, words: int) -> list[Column]:
    """Aggregates over the elements of a set, repeats or not: bit k of word w tells whether an element falls there."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), element.bitwiseAND(F.lit(63)).cast("int"))
    at = F.shiftrightunsigned(element, 6).bitwiseAND(F.lit(words - 1))
    return [F.bit_or(F.when(at == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(words)]


def _mains(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each key with several components: its rows and the component that most of them have."""
    many = rows.groupBy(*key, "component").agg(F.count("*").alias("k"))
    of = many.groupBy(*key).agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("m"), F.count("*").alias("kinds"))
    return of.where("kinds > 1").drop("kinds")


def _strangers_met(each: DataFrame, key: list[str], fits: str) -> DataFrame:
    """each(key, id, component, main, n, ...) -> pairs (a, b) of different components that share a key and fit."""
    same = " and ".join(f"x.{k} = y.{k}" for k in key)
    x, y = each.where("component != main").alias("x"), each.alias("y")
    met = x.join(y, F.expr(f"{same} and x.component != y.component and (y.component = y.main or x.id < y.id) and {fits}"))
    return met.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b"))


def _by_prefix(ids: DataFrame, elements: DataFrame, percent: int, rough: DataFrame, fits: str) -> DataFrame:
    """ids(id, component), elements(id, s), rough(id, words) -> pairs that may be links: two sets that are similar share one of
    the first n - ceil(percent * n / 100) + 1 of their elements in any common order. Rare elements come first in it."""
    counts = elements.groupBy("s").agg(F.count("*").alias("f"))
    order = elements.join(counts, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("o"))
    order = order.withColumn("n", F.size("o").cast("long"))
    first = order.select("id", "n", F.posexplode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1).cast("int"))).alias("pos", "e"))
    rows = first.where("e.f > 1").select("id", "n", "pos", "e.s").join(ids, "id")
    rows = materialize(rows, "prefixes")
    each = rows.join(_mains(rows, ["s"]), "s").join(rough, "id")
    left = f"(least(x.n - x.pos, y.n - y.pos)) * {100 + percent} >= {percent} * (x.n + y.n)"
    sizes = f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent}"
    return _strangers_met(each, ["s"], f"{sizes} and {left} and {fits}")


def settle(rows: DataFrame, store: DataFrame, known: DataFrame, sets: Sets) -> DataFrame:
    """Rows (bucket, id, component) of open buckets -> the pairs (a, b) across components that may be links, once each."""
    rows = rows.select("bucket", "id", "component")
    size = F.lit(0)
    if sets.exact:  # sizes of a link differ by one class at most
        rows = rows.join(known.select("id", "n"), "id")
        size = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / sets.percent) * 1.0001)).cast("int")
        size = F.explode(F.array(size, size + 1))
    rows = materialize(rows.select("bucket", "id", "component", size.alias("size")), "parts")
    key = ["bucket", "size"]
    each = rows.join(_mains(rows, key), key)
    # the same rows meet in many buckets: there by short sketches, then once by all words
    few = min(sets.words, SHORT)
    rough = sets.folded(known, few)
    pairs = _strangers_met(each.where(F.col("m") <= sets.most).join(rough, "id"), key, sets.fits(few))
    large = materialize(each.where(F.col("m") > sets.most).select("id", "component").distinct(), "large")
    if not large.isEmpty():
        elements = sets.elements(large.select("id"), store)
        pairs = pairs.unionByName(_by_prefix(large, elements, sets.percent, rough.select("id", "words"), sets.fits(few)))
    return sets.likely(pairs.distinct(), known)


def similar_classes(buckets: DataFrame | Signed, prepare: Callable[[DataFrame], DataFrame], verify: Verify, sets: Sets) -> DataFrame:
    """buckets(bucket long, id long), or what they are made of -> (node, component): the classes of ids under verified links.

    Only ids with a link are returned. An id may be in many buckets; one in a bucket of its own is never compared. prepare
    gets the ids (id) that share a bucket with another and makes what verify needs of them, once.
    """
    shared = shared_in_turns(buckets) if isinstance(buckets, Signed) else [materialize(shared_buckets(buckets), "buckets")]
    met = reduce(DataFrame.unionByName, shared)
    store = prepare(met.select("id").distinct())
    known = materialize(sets.sketch(store), "sketches")
    links = materialize(verify(sets.likely(first_pairs(met, known, sets).distinct(), known), store), "links")
    found = _joined(None, links)
    rows = materialize(open_buckets(met.where(F.col("m") > FEW), found), "open")
    if not rows.isEmpty():
        strangers = rows.where("component != main").select("bucket", "id", "hub")
        seconds = strangers.groupBy("bucket").agg(F.min("id").alias("second"))
        met_second = strangers.join(seconds, "bucket")
        more = met_second.select(F.least("id", "second").alias("a"), F.greatest("id", "second").alias("b")).unionByName(
            met_second.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        )
        found = _joined(found, materialize(verify(sets.likely(more.where("a != b").distinct(), known), store), "links"))
        last = materialize(settle(open_buckets(rows.select("bucket", "id", "hub"), found), store, known, sets), "pairs")
        found = _joined(found, materialize(verify(last, store), "links"))
        discard(last)
    discard(*shared, store, known, rows)
    return found


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes after more links (written ones, which go); those found so far are stars already."""
    if found is not None and links.isEmpty():
        return found
    known = links if found is None else found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    out = materialize(components(known), "classes")
    discard(links, *([found] if found is not None else []))
    return out
