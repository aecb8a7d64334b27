"""Edition lengths, best positions and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDITION = ("lijst", "jaar", "week")


def edition_length(entries: DataFrame) -> DataFrame:
    """The last place of each edition: the basis of all points."""
    return entries.groupBy(*EDITION).agg(F.max("positie").alias("lengte"))


def best_positions(entries: DataFrame) -> DataFrame:
    """One row per key and edition: of several places the best counts. The last spelling in order stands for it."""
    return entries.groupBy(*EDITION, "sleutel").agg(F.min("positie").alias("positie"), F.max_by("titel", "positie").alias("titel"), F.max_by("artiest", "positie").alias("artiest"))


def scored(entries: DataFrame) -> DataFrame:
    """best_positions with lengte and punten = lengte - positie + 1. One shuffle: the length is a window over editions."""
    long = entries.withColumn("lengte", F.max("positie").over(Window.partitionBy(*EDITION)))
    best = long.groupBy(*EDITION, "sleutel").agg(F.min("positie").alias("positie"), F.max_by("titel", "positie").alias("titel"), F.max_by("artiest", "positie").alias("artiest"), F.max("lengte").alias("lengte"))
    return best.withColumn("punten", F.col("lengte") - F.col("positie") + 1)


def year_ranking(entries: DataFrame) -> DataFrame:
    """Points, peak and weeks of each key in each chart and year, with its place in that year's ranking."""
    each = scored(entries).groupBy("lijst", "jaar", "sleutel").agg(
        F.sum("punten").alias("punten"), F.min("positie").alias("hoogste"), F.count("*").alias("weken"), F.min("week").alias("eerste_week"), F.max_by("titel", "week").alias("titel"), F.max_by("artiest", "week").alias("artiest")
    )
    order = Window.partitionBy("lijst", "jaar").orderBy(F.desc("punten"), "hoogste", "eerste_week", "sleutel")
    return each.withColumn("plek", F.row_number().over(order))


def range_totals(entries: DataFrame, first: int, last: int, overrides: DataFrame | None = None) -> DataFrame:
    """Points, weeks, peak, best year and years of each key over a range of years.

    overrides(lijst, jaar, sleutel, punten, hoogste, weken) replace a key's own figures of a year; the best year counts own
    points. Ties of the best year go to the earliest.
    """
    year = scored(entries.where(F.col("jaar").between(first, last))).groupBy("lijst", "sleutel", "jaar").agg(
        F.sum("punten").alias("eigen"), F.min("positie").alias("peak"), F.count("*").alias("n")
    )
    if overrides is not None:
        given = overrides.select("lijst", "sleutel", "jaar", F.col("punten").alias("op"), F.col("hoogste").alias("oh"), F.col("weken").alias("ow"))
        year = year.join(given, ["lijst", "sleutel", "jaar"], "left")
    else:
        year = year.select("*", *[F.lit(None).cast("long").alias(c) for c in ("op", "oh", "ow")])
    return year.groupBy("lijst", "sleutel").agg(
        F.sum(F.coalesce("op", "eigen")).cast("long").alias("punten"),
        F.sum(F.coalesce("ow", "n")).cast("long").alias("weken"),
        F.min(F.coalesce("oh", "peak")).cast("int").alias("hoogste"),
        F.min_by("jaar", F.struct(-F.col("eigen"), F.col("jaar"))).alias("beste_jaar"),
        F.count("*").alias("jaren"),
    )


def decade_totals(entries: DataFrame) -> DataFrame:
    """Points, weeks and peak of each decade in one pass (without overrides; range_totals takes those)."""
    return scored(entries).groupBy("lijst", (F.col("jaar") - F.col("jaar") % 10).alias("decennium"), "sleutel").agg(
        F.sum("punten").alias("punten"), F.count("*").alias("weken"), F.min("positie").alias("hoogste")
    )


def annual_combined(entries: DataFrame, prefix: str = "jr_") -> DataFrame:
    """The combined ranking of annual charts: normalised points (length - position + 1) / length over all rows.

    Points are summed as whole numbers for each length first, so the order of rows can't change a sum.
    """
    rows = entries.where(F.col("lijst").startswith(prefix)).withColumn("lengte", F.max("positie").over(Window.partitionBy("lijst", "jaar", "week")))
    parts = rows.groupBy("sleutel", "lengte").agg(
        F.sum(F.col("lengte") - F.col("positie") + 1).alias("p"), F.count("*").alias("n"), F.min(F.struct("positie", "jaar", "lijst")).alias("b"), F.collect_set("lijst").alias("ls")
    )
    return parts.groupBy("sleutel").agg(
        F.bround(F.sum(F.bround(F.col("p") / F.col("lengte"), 6).cast("decimal(20,6)")).cast("double"), 1).alias("punten"),
        F.sum("n").alias("noteringen"),
        F.min("b.positie").alias("hoogste"),
        F.min("b").getField("jaar").alias("hoogste_jaar"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ls")))).cast("long").alias("lijsten"),
    )


def artist_ranking(entries: DataFrame) -> DataFrame:
    """Entries, songs, charts, weeks at number one (weekly charts only) and years of each artist; empty artists are skipped."""
    artist = F.substring_index("sleutel", "|", 1)
    return entries.where(artist != "").groupBy(artist.alias("artiestsleutel")).agg(
        F.count("*").alias("noteringen"), F.count_distinct("sleutel").alias("nummers"), F.count_distinct("lijst").alias("lijsten"),
        F.count_if((F.col("positie") == 1) & F.col("lijst").startswith("wk_")).alias("weken_op_een"), F.min("jaar").alias("eerste_jaar"), F.max("jaar").alias("laatste_jaar"), F.max("artiest").alias("artiest"),
    )
