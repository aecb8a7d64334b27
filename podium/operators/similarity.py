"""Similarity joins that lose no pair: candidates by shared segments of an index, then the exact likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.functions.ratio import likeness


def _edits(n: Column, least: float, gap: int) -> Column:
    """The most characters that a name of length n and a longer partner don't share: likeness is 2M/T, so T - 2M <= (1-least)*T,
    where the longer one has at most n*(2-least)/least characters and at most `gap` more."""
    longer = F.least(F.floor(n * F.lit((2 - least) / least) + F.lit(1e-9)), n + F.lit(gap))
    return F.floor((n + longer) * F.lit(1 - least) + F.lit(1e-9))


def _segments(n: Column, edits: Column, spare: int) -> Column:
    """(nr, place from 1, length) of edits + 1 + spare even segments of a name of length n, at most n of them."""
    count = F.least(edits + 1 + F.lit(spare), n)
    start = lambda k: F.floor(k * n / count)
    return F.transform(
        F.sequence(F.lit(0).cast("long"), count.cast("long") - 1),
        lambda k: F.struct(k.alias("nr"), (start(k) + 1).cast("int").alias("van"), (start(k + 1) - start(k)).cast("int").alias("lang")),
    )


def similar_join(names: DataFrame, group: list[str], least: float, gap: int) -> DataFrame:
    """names(group..., naam) -> (group..., a, b, gelijkenis): all pairs a < b of a group that differ by at most `gap` in length
    and whose likeness (a first) is at least `least`, above 2/3. Repeated and null names count once and never; the empty name
    has no partner."""
    pairs = near_pairs(names, group, least, gap)
    return pairs.withColumn("gelijkenis", likeness(F.col("a"), F.col("b"), least)).where(F.col("gelijkenis") >= least)


def near_pairs(names: DataFrame, group: list[str], least: float, gap: int, spare: int = 2) -> DataFrame:
    """Candidates of similar_join: (group..., a, b), a < b, among them all pairs whose likeness is at least `least` either way round.

    No pair is lost. Matching characters stand in the same order in both, so a pair shares all but e characters. Of e + 1 + spare
    segments of the shorter name at least spare + 1 are left whole, each within e places of where it was; so one of its e + 1
    rarest segments meets a piece of the longer name. Only these are in the index, which keeps frequent beginnings out.
    """
    own = names.select(*group, "naam").where(F.length("naam") > 0).distinct().withColumn("n", F.length("naam"))
    segment = F.explode(_segments(F.col("n"), _edits(F.col("n"), least, gap), spare)).alias("s")
    cut = own.select(*group, "naam", "n", segment).select(
        *group, F.col("naam").alias("kort"), "n", "s.nr", F.substring("naam", F.col("s.van"), F.col("s.lang")).alias("stuk")
    )
    place = [*group, "n", "nr", "stuk"]
    rare = Window.partitionBy(*group, "kort").orderBy("vaak", "nr")
    counted = cut.join(cut.groupBy(*place).agg(F.count("*").alias("vaak")), [*place])
    index = counted.withColumn("r", F.row_number().over(rare)).where(F.col("r") <= _edits(F.col("n"), least, gap) + 1).select(*place, "kort")
    # the longer name of a pair asks for pieces of its own, at each length that a shorter partner may have
    m = F.col("m")
    fewest = F.greatest(F.ceil(m * F.lit(least / (2 - least)) - F.lit(1e-9)), m - F.lit(gap), F.lit(1))
    asked = own.select(*group, F.col("naam").alias("lang_"), F.col("n").alias("m")).withColumn("n", F.explode(F.sequence(fewest.cast("int"), m)))
    asked = asked.withColumn("e", _edits(F.col("n"), least, gap)).withColumn("s", F.explode(_segments(F.col("n"), F.col("e"), spare)))
    more = m - F.col("n")
    shift = F.explode(F.sequence((-F.floor((F.col("e") - more) / 2)).cast("int"), F.floor((F.col("e") + more) / 2).cast("int"))).alias("d")
    asked = asked.where(F.col("e") >= more).select(*group, "lang_", "m", "n", "s", shift)
    at = F.col("s.van") + F.col("d")
    asked = asked.where((at >= 1) & (at + F.col("s.lang") - 1 <= m)).select(*group, "lang_", "n", "s.nr", F.substring("lang_", at, F.col("s.lang")).alias("stuk")).distinct()
    met = asked.join(index, place).where((F.col("kort") != F.col("lang_")) & ((F.col("n") < F.length("lang_")) | (F.col("kort") < F.col("lang_"))))
    pairs = met.select(*group, F.least("kort", "lang_").alias("a"), F.greatest("kort", "lang_").alias("b")).distinct()
    return pairs


def contained_join(names: DataFrame, group: list[str], by: str, width: int = 3) -> DataFrame:
    """names(group..., by, ...) -> (group..., klein, groot): all pairs of different rows' texts of which one has the other as a part,
    equal texts too (then both ways). Empty texts take no part.

    A text is found by the rarest of its runs of `width` letters (itself, if shorter) among all such runs of the others.
    """
    own = names.select(*group, F.col(by).alias("t")).where(F.length("t") > 0).distinct()

    def runs(of: DataFrame, widths: Column) -> DataFrame:
        each = F.explode(F.array_distinct(F.flatten(F.transform(widths, lambda w: F.transform(F.sequence(F.lit(1), F.length("t") - w + 1), lambda i: F.substring(F.col("t"), i, w))))))
        return of.select(*group, "t", each.alias("stuk"))

    longest = F.least(F.length("t"), F.lit(width))
    around = runs(own, F.sequence(F.lit(1), longest))
    often = around.groupBy(*group, "stuk").agg(F.count("*").alias("vaak"))
    anchor = runs(own, F.array(longest)).join(often, [*group, "stuk"]).groupBy(*group, "t").agg(F.min(F.struct("vaak", "stuk")).alias("x"))
    anchor = anchor.select(*group, F.col("t").alias("klein"), F.col("x.stuk").alias("stuk"))
    return around.withColumnRenamed("t", "groot").join(anchor, [*group, "stuk"]).where(F.contains("groot", "klein")).select(*group, "klein", "groot")
