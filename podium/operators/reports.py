"""Reports on charts: records, new entries, drop-outs, week reports, profiles, editions, search, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_chart(entries: DataFrame, chart: str, year: int, week: int) -> DataFrame:
    return entries.where((F.col("lijst") == chart) & (F.col("jaar") == year) & (F.col("week") == week)).select("positie", "titel", "artiest", "sleutel")


def one_hit_wonders(entries: DataFrame) -> DataFrame:
    """Artists with one song that reached number one."""
    each = entries.groupBy(F.substring_index("sleutel", "|", 1).alias("artiestsleutel")).agg(F.count_distinct("sleutel").alias("n"), F.min("positie").alias("hoogste"), F.max("sleutel").alias("sleutel"))
    return each.where("n = 1 and hoogste = 1").select("artiestsleutel", "sleutel")


def songs_per_artist(entries: DataFrame, top: int = 10) -> DataFrame:
    """The artists with most songs in each chart."""
    each = entries.groupBy("lijst", F.substring_index("sleutel", "|", 1).alias("artiestsleutel")).agg(F.count_distinct("sleutel").alias("nummers"), F.count("*").alias("noteringen"))
    order = Window.partitionBy("lijst").orderBy(F.desc("nummers"), F.desc("noteringen"), "artiestsleutel")
    return each.withColumn("plek", F.row_number().over(order)).where(F.col("plek") <= top)


def longest_charted(entries: DataFrame, at_one: bool = False, top: int = 10) -> DataFrame:
    """The songs with most editions in a chart (or most at number one)."""
    rows = entries.where("positie = 1") if at_one else entries
    each = rows.groupBy("lijst", "sleutel").agg(F.count_distinct("jaar", "week").alias("weken"), F.min("positie").alias("hoogste"), F.min("jaar").alias("van"), F.max("jaar").alias("tot"))
    order = Window.partitionBy("lijst").orderBy(F.desc("weken"), "sleutel")
    return each.withColumn("plek", F.row_number().over(order)).where(F.col("plek") <= top)


def new_in_year(entries: DataFrame) -> DataFrame:
    """Rows of the first week of a key in its year."""
    first = F.min("week").over(Window.partitionBy("lijst", "jaar", "sleutel"))
    return entries.withColumn("eerste", first).where("week = eerste").select("lijst", "jaar", "week", "sleutel").distinct()


def new_ever(entries: DataFrame) -> DataFrame:
    """The first year of each key in each chart."""
    return entries.groupBy("lijst", "sleutel").agg(F.min("jaar").alias("jaar"))


def drop_outs(entries: DataFrame) -> DataFrame:
    """Keys of an edition that are not in the chart's next one."""
    days = entries.select("lijst", "jaar", "week").distinct()
    idx = days.withColumn("idx", F.row_number().over(Window.partitionBy("lijst").orderBy("jaar", "week")))
    own = entries.select("lijst", "jaar", "week", "sleutel").distinct().join(idx, ["lijst", "jaar", "week"])
    last = idx.groupBy("lijst").agg(F.max("idx").alias("last"))
    next_ = own.select("lijst", "sleutel", (F.col("idx") - 1).alias("idx"))
    return own.join(last, "lijst").where("idx < last").join(next_, ["lijst", "sleutel", "idx"], "left_anti").select("lijst", "jaar", "week", "sleutel")


def week_summary(entries: DataFrame) -> DataFrame:
    """Number one, entries, new keys and the biggest climber of each edition against the edition before."""
    best = entries.groupBy("lijst", "jaar", "week", "sleutel").agg(F.min("positie").alias("positie"))
    days = entries.select("lijst", "jaar", "week").distinct()
    idx = days.withColumn("idx", F.row_number().over(Window.partitionBy("lijst").orderBy("jaar", "week")))
    own = best.join(idx, ["lijst", "jaar", "week"])
    order = Window.partitionBy("lijst", "sleutel").orderBy("idx")
    own = own.withColumn("voor", F.when(F.lag("idx").over(order) == F.col("idx") - 1, F.lag("positie").over(order))).withColumn("ooit", F.lag("idx").over(order))
    rise = F.col("voor") - F.col("positie")
    return own.groupBy("lijst", "jaar", "week").agg(
        F.min_by("sleutel", F.struct("positie", "sleutel")).alias("nummer_een"), F.count("*").alias("nummers"), F.count_if(F.col("ooit").isNull()).alias("nieuw"),
        F.count_if(F.col("ooit").isNotNull() & F.col("voor").isNull()).alias("terug"), F.max(F.when(rise > 0, rise)).alias("grootste_stijging"), F.max(F.when(rise < 0, -rise)).alias("grootste_daling"),
    )


def year_profile(entries: DataFrame) -> DataFrame:
    first = F.min("jaar").over(Window.partitionBy("lijst", "sleutel")) == F.col("jaar")
    return entries.withColumn("f", first).groupBy("lijst", "jaar").agg(
        F.count_distinct("sleutel").alias("nummers"), F.count("*").alias("noteringen"), F.count_distinct(F.when(F.col("positie") == 1, F.col("sleutel"))).alias("op_een"), F.count_distinct(F.when(F.col("f"), F.col("sleutel"))).alias("eerste_keer")
    )


def compare_years(entries: DataFrame, a: int, b: int) -> DataFrame:
    """Keys charted in both years, best position in each: both sides are aggregated before the join."""
    side = lambda y, n: entries.where(F.col("jaar") == y).groupBy("lijst", "sleutel").agg(F.min("positie").alias(n))
    return side(a, "positie_a").join(side(b, "positie_b"), ["lijst", "sleutel"])


def chart_overview(entries: DataFrame) -> DataFrame:
    """Span, editions, entries and shortest and longest edition of each chart."""
    each = entries.groupBy("lijst", "jaar", "week").agg(F.max("positie").alias("lengte"), F.count("*").alias("n"))
    return each.groupBy("lijst").agg(
        F.min("jaar").alias("van"), F.max("jaar").alias("tot"), F.count_distinct("jaar").alias("jaren"), F.count("*").alias("edities"), F.sum("n").alias("noteringen"), F.min("lengte").alias("kortste"), F.max("lengte").alias("langste")
    )


def edition_history(entries: DataFrame) -> DataFrame:
    """Annual charts: previous edition's position, last year seen before, editions so far and best ever of each entry."""
    rows = entries.where(F.col("lijst").startswith("jr_")).groupBy("lijst", "jaar", "week", "sleutel").agg(F.min("positie").alias("positie"))
    idx = rows.select("lijst", "jaar", "week").distinct().withColumn("idx", F.row_number().over(Window.partitionBy("lijst").orderBy("jaar", "week")))
    order = Window.partitionBy("lijst", "sleutel").orderBy("idx")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(idx, ["lijst", "jaar", "week"])
    return rows.select(
        "lijst", "jaar", "week", "sleutel", "positie", F.when(F.lag("idx").over(order) == F.col("idx") - 1, F.lag("positie").over(order)).alias("vorige"), F.lag("jaar").over(order).alias("laatst"),
        F.count("*").over(past).alias("edities"), F.min("positie").over(Window.partitionBy("lijst", "sleutel")).alias("beste"),
    )


def editions_list(entries: DataFrame) -> DataFrame:
    days = entries.where(F.col("lijst").startswith("jr_")).select("lijst", "jaar", "week").distinct()
    return days.select("*", F.row_number().over(Window.partitionBy("lijst").orderBy("jaar", "week")).alias("nr"), F.count("*").over(Window.partitionBy("lijst", "jaar")).alias("per_jaar"))


def title_families(entries: DataFrame) -> DataFrame:
    """Titles that several keys share."""
    each = entries.groupBy(F.substring_index("sleutel", "|", -1).alias("titelsleutel")).agg(F.count_distinct("sleutel").alias("versies"), F.array_join(F.sort_array(F.collect_set("sleutel")), ";").alias("leden"))
    return each.where("versies >= 2")


def cross_reference(entries: DataFrame, chart: str) -> DataFrame:
    """How many keys of a chart occur in each other chart."""
    keys = entries.where(F.col("lijst") == chart).select("sleutel").distinct()
    return entries.where(F.col("lijst") != chart).join(keys, "sleutel", "left_semi").groupBy("lijst").agg(F.count_distinct("sleutel").alias("nummers"))


def artist_page(entries: DataFrame, artist: str) -> DataFrame:
    rows = entries.where(F.col("sleutel").startswith(artist + "|"))
    return rows.groupBy("sleutel").agg(F.count("*").alias("noteringen"), F.min("jaar").alias("van"), F.max("jaar").alias("tot"), F.min("positie").alias("hoogste"), F.array_join(F.sort_array(F.collect_set("lijst")), ",").alias("lijsten"))


_ASCII = {c: c + 32 for c in range(65, 91)}


def ascii_lower(c: Column) -> Column:
    """A-Z in small letters; É and the like stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_pattern(term: str, exact: bool = False) -> str:
    """A LIKE pattern for a search term: * stands for anything, % _ and backslash for themselves; contains by default."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return escaped if exact else f"%{escaped}%"


def search(entries: DataFrame, term: str, exact: bool = False, top: int = 200) -> DataFrame:
    """Keys whose artist or title fits, without regard to the case of A-Z, with figures per chart, most entries first.

    A pipe splits the term: both the artist and the title must fit then. Blanks at the edges of a term count.
    """
    fits = lambda c, t: ascii_lower(F.col(c)).like(like_pattern(t.translate(_ASCII), exact))
    if "|" in term:
        a, t = term.split("|", 1)
        where: Column = fits("artiest", a) & fits("titel", t)
    else:
        where = fits("artiest", term) | fits("titel", term)
    each = entries.where(where).groupBy("sleutel", "lijst").agg(
        F.count("*").alias("noteringen"), F.min("jaar").alias("van"), F.max("jaar").alias("tot"), F.min("positie").alias("hoogste"), F.min_by("jaar", F.struct("positie", "jaar")).alias("piekjaar")
    )
    return each.orderBy(F.desc("noteringen"), "sleutel", "lijst").limit(top)


def missing_positions(entries: DataFrame) -> DataFrame:
    """Editions whose positions aren't 1..n, with what is missing."""
    each = entries.groupBy("lijst", "jaar", "week").agg(F.collect_set("positie").alias("p"), F.max("positie").alias("lengte"))
    gone = F.array_except(F.sequence(F.lit(1), F.col("lengte")), F.col("p"))
    return each.where(F.size(gone) > 0).select("lijst", "jaar", "week", F.size(gone).cast("long").alias("n"), F.array_join(F.sort_array(gone), ",").alias("ontbreekt"))


def missing_weeks(entries: DataFrame) -> DataFrame:
    """Weeks of a weekly chart without an edition, between its first and last week of a year."""
    each = entries.where(F.col("lijst").startswith("wk_")).groupBy("lijst", "jaar").agg(F.collect_set("week").alias("w"), F.min("week").alias("a"), F.max("week").alias("b"))
    return each.select("lijst", "jaar", F.explode(F.array_except(F.sequence("a", "b"), "w")).alias("week"))


def shared_keys(entries: DataFrame) -> DataFrame:
    """Keys that stand more than once in an edition."""
    return entries.groupBy("lijst", "jaar", "week", "sleutel").agg(F.count("*").alias("n")).where("n > 1")


def mode_spelling(entries: DataFrame) -> DataFrame:
    """The most used artist spelling of each artist key, the last in order on ties."""
    each = entries.groupBy(F.substring_index("sleutel", "|", 1).alias("artiestsleutel"), "artiest").agg(F.count("*").alias("n"))
    return each.groupBy("artiestsleutel").agg(F.max(F.struct("n", "artiest")).alias("m")).select("artiestsleutel", "m.artiest", "m.n")


def side_credits(entries: DataFrame, separators: tuple[str, ...] = (" & ", " x ", " and ", " feat ", " met ")) -> DataFrame:
    """Artists whose key starts with a bigger artist's key and a separator belong to that one: an equi-join on the cut key."""
    each = entries.groupBy(F.substring_index("sleutel", "|", 1).alias("artiest")).agg(F.count_distinct("sleutel").alias("n"))
    cut = each.select("artiest", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.substring_index("artiest", s, 1).alias("hoofd")) for i, s in enumerate(separators)])).alias("c"))
    cut = cut.select("artiest", "n", "c.*").where("hoofd != artiest")
    big = each.select(F.col("artiest").alias("hoofd"), F.col("n").alias("m"))
    return cut.join(big, "hoofd").where("m > n").groupBy("artiest").agg(F.min_by("hoofd", "o").alias("hoofd"))
