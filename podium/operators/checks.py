"""Validation of entries and editions, ledgers of what is there and what is missing, reconciliation of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_EDITION = ("lijst", "jaar", "week")
STATUSES = ("nieuw", "terug", "stijger", "daler", "gelijk", "onbekend")


def row_faults(source: DataFrame) -> DataFrame:
    """Entries that break a rule, with `fout`: unknown status, position under 1, empty title or artist; the first that applies."""
    fault = (
        F.when(~F.coalesce(F.col("site_status").isin(*STATUSES), F.lit(False)), "status").when(~F.coalesce(F.col("positie") >= 1, F.lit(False)), "positie")
        .when(F.trim(F.coalesce("titel", F.lit(""))) == "", "titel").when(F.trim(F.coalesce("artiest", F.lit(""))) == "", "artiest")
    )
    return source.withColumn("fout", fault).where("fout is not null").select(*_EDITION, "positie", "sleutel", "fout")


def edition_structure(source: DataFrame, expected: DataFrame | None = None, holes: int = 2) -> DataFrame:
    """(lijst, jaar, week, lengte, gaten, gedeeld, dubbel, nieuw_met_vorige, klopt): positions must be 1..n with at most `holes`
    missing, shared positions are allowed, the same song twice on one position isn't; a new entry has no position before;
    expected(lijst, verwacht) gives the length of each edition of a chart."""
    place = source.groupBy(*_EDITION, "positie", F.lower("artiest").alias("a"), F.lower("titel").alias("t")).agg(F.count("*").alias("n"), F.count_if((F.col("site_status") == "nieuw") & F.col("vorige_positie").isNotNull()).alias("nv"))
    each = place.groupBy(*_EDITION).agg(
        F.max("positie").alias("lengte"), (F.max("positie") - F.count_distinct("positie")).alias("gaten"), (F.sum("n") - F.count_distinct("positie")).alias("gedeeld"), F.sum(F.col("n") - 1).alias("dubbel"), F.sum("nv").alias("nieuw_met_vorige")
    )
    ok = (F.col("gaten") <= holes) & (F.col("dubbel") == 0) & (F.col("nieuw_met_vorige") == 0)
    if expected is not None:
        each = each.join(expected, "lijst", "left")
        ok = ok & F.coalesce(F.col("lengte") == F.col("verwacht"), F.lit(True))
    return each.withColumn("klopt", ok).select(*_EDITION, "lengte", "gaten", "gedeeld", "dubbel", "nieuw_met_vorige", "klopt")


def edition_quality(entries: DataFrame, nominal: DataFrame) -> DataFrame:
    """nominal(lijst, nominaal) -> (lijst, jaar, week, ernst, melding, n) of annual editions: longer than nominal and more than
    max(5, 1 %) missing are errors, shared and missing positions warnings."""
    each = entries.groupBy(*_EDITION).agg(F.max("positie").alias("lengte"), F.count("*").alias("n"), F.count_distinct("positie").alias("p")).join(nominal, "lijst")
    gone, shared = F.col("lengte") - F.col("p"), F.col("n") - F.col("p")
    found = F.array_compact(
        F.array(
            F.when(F.col("lengte") > F.col("nominaal"), F.struct(F.lit("fout").alias("ernst"), F.lit("te lang").alias("melding"), F.col("lengte").cast("long").alias("aantal"))),
            F.when(shared > 0, F.struct(F.lit("waarschuwing").alias("ernst"), F.lit("gedeeld").alias("melding"), shared.alias("aantal"))),
            F.when(gone > 0, F.struct(F.lit("waarschuwing").alias("ernst"), F.lit("ontbreekt").alias("melding"), gone.alias("aantal"))),
            F.when(gone > F.greatest(F.lit(5), F.floor(F.col("lengte") / 100)), F.struct(F.lit("fout").alias("ernst"), F.lit("ontbreekt veel").alias("melding"), gone.alias("aantal"))),
        )
    )
    return each.select(*_EDITION, F.explode(found).alias("f")).select(*_EDITION, "f.*")


def several_spellings(entries: DataFrame) -> DataFrame:
    """Keys with more than one title, which an archive shouldn't have."""
    return entries.groupBy("sleutel").agg(F.count_distinct("titel").alias("titels")).where("titels > 1")


def hole_neighbours(entries: DataFrame) -> DataFrame:
    """(lijst, jaar, week, positie, na, voor): the holes in editions, with the places around each hole that are there."""
    p = entries.select(*_EDITION, "positie").distinct()
    near = p.withColumn("volgend", F.lead("positie").over(Window.partitionBy(*_EDITION).orderBy("positie"))).where("volgend > positie + 1")
    inner = near.select(*_EDITION, F.explode(F.sequence(F.col("positie") + 1, F.col("volgend") - 1)).alias("gat"), F.col("positie").alias("na"), F.col("volgend").alias("voor"))
    least = p.groupBy(*_EDITION).agg(F.min("positie").alias("voor")).where("voor > 1")
    start = least.select(*_EDITION, F.explode(F.sequence(F.lit(1), F.col("voor") - 1)).alias("gat"), F.lit(None).cast("int").alias("na"), "voor")
    return inner.unionByName(start).withColumnRenamed("gat", "positie")


def repeated_editions(entries: DataFrame) -> DataFrame:
    """Editions with exactly the positions and keys of the chart's edition before."""
    own = entries.groupBy(*_EDITION).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("\u0001", "positie", "sleutel"))), "\u0002"), 256).alias("h"))
    order = Window.partitionBy("lijst").orderBy("jaar", "week")
    return own.withColumn("vorige", F.lag("h").over(order)).where("h = vorige").select(*_EDITION)


def count_differences(counts: DataFrame, entries: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """counts(lijst, jaar, week, positie, bron) -> positions where source and archive have different numbers of entries;
    accepted(lijst, jaar, week, positie) are left out."""
    own = entries.groupBy(*_EDITION, "positie").agg(F.count("*").alias("archief"))
    both = counts.join(own, [*_EDITION, "positie"], "full").select(*_EDITION, "positie", F.coalesce("bron", F.lit(0)).alias("bron"), F.coalesce("archief", F.lit(0)).alias("archief"))
    both = both.where("bron != archief")
    return both if accepted is None else both.join(accepted, [*_EDITION, "positie"], "left_anti")


def ledger(entries: DataFrame) -> DataFrame:
    """(lijst, jaar, week, aantal) of the editions there are."""
    return entries.groupBy(*_EDITION).agg(F.count("*").alias("aantal"))


def weeks_to_fetch(known: DataFrame, absent: DataFrame, published: DataFrame) -> DataFrame:
    """known, absent(lijst, jaar, week), published(lijst, jaar, tot) -> the weeks 1..tot that are neither known nor known not to
    exist."""
    have = known.select(*_EDITION).unionByName(absent.select(*_EDITION)).distinct()
    asked = published.select("lijst", "jaar", F.explode(F.sequence(F.lit(1), "tot")).alias("week"))
    return asked.join(have, list(_EDITION), "left_anti")


def truncated_tail(known: DataFrame, last: int = 53) -> DataFrame:
    """The weeks after the last known one of each closed chart-year (all but a chart's last year)."""
    each = known.groupBy("lijst", "jaar").agg(F.max("week").alias("hoogste")).withColumn("eind", F.max("jaar").over(Window.partitionBy("lijst")))
    return each.where((F.col("jaar") < F.col("eind")) & (F.col("hoogste") < last)).select("lijst", "jaar", F.explode(F.sequence(F.col("hoogste") + 1, F.lit(last))).alias("week"))


def tombstones(failed: DataFrame, running_year: int) -> DataFrame:
    """failed(lijst, jaar, week, reden) -> one row for each edition of a closed year that doesn't exist; the running year's are
    tried again."""
    closed = failed.where((F.col("jaar") < running_year) & F.col("reden").isin("404", "andere week"))
    return closed.groupBy(*_EDITION).agg(F.min("reden").alias("reden"))


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows put in place of those with the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(table.columns))


def without(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")
