"""Full rankings: year pages, totals over years, song pages, artists' records, week reports and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.operators.ordering import ranked
from podium.operators.points import best_positions, range_totals, scored
from podium.operators.runs import calendar_index, friday, run_edges, run_span, sequence


def _artist() -> Column:
    return F.substring_index("sleutel", "|", 1)


def full_totals(entries: DataFrame, first: int, last: int, overrides: DataFrame | None = None) -> DataFrame:
    """range_totals with the last spelling, the years, the Fridays of the first and last edition, and whether the run of the
    first one began before the range and that of the last one goes on after it."""
    own = entries.where(F.col("jaar").between(first, last))
    when = F.struct("jaar", "week", "positie")
    more = own.groupBy("lijst", "sleutel").agg(
        F.max_by("titel", when).alias("titel"), F.max_by("artiest", when).alias("artiest"), F.array_join(F.sort_array(F.collect_set("jaar")), ",").alias("jaartallen"),
        F.min(F.struct("jaar", "week")).alias("a"), F.max(F.struct("jaar", "week")).alias("z"),
    )
    out = range_totals(entries, first, last, overrides).join(more, ["lijst", "sleutel"])
    edges = run_edges(entries, [first, last]).select("lijst", "sleutel", F.col("vroeger_0").alias("begon_eerder"), F.col("later_1").alias("loopt_door"))
    out = out.join(edges, ["lijst", "sleutel"], "left")
    return out.select(
        "lijst", "sleutel", "titel", "artiest", "punten", "weken", "hoogste", "beste_jaar", "jaren", "jaartallen",
        friday(F.col("a.jaar"), F.col("a.week")).alias("eerste_dag"), friday(F.col("z.jaar"), F.col("z.week")).alias("laatste_dag"),
        F.coalesce("begon_eerder", F.lit(False)).alias("begon_eerder"), F.coalesce("loopt_door", F.lit(False)).alias("loopt_door"),
    )


def year_page(entries: DataFrame, chart: str, year: int) -> DataFrame:
    """A chart-year ranked by points, peak, first week and title, with first and last week, editions at one, and what stands out:
    the leader, most weeks at one, most weeks."""
    rows = scored(entries.where((F.col("lijst") == chart) & (F.col("jaar") == year)))
    each = rows.groupBy("sleutel").agg(
        F.sum("punten").alias("punten"), F.min("positie").alias("hoogste"), F.count("*").alias("weken"), F.count_if(F.col("positie") == 1).alias("op_een"), F.min("week").alias("eerste_week"),
        F.max("week").alias("laatste_week"), F.max_by("titel", "week").alias("titel"), F.max_by("artiest", "week").alias("artiest"),
    )
    top = each.agg(F.max("op_een").alias("mo"), F.max("weken").alias("mw"))  # one row
    order = [F.desc("punten"), F.col("hoogste"), F.col("eerste_week"), F.lower("titel"), F.col("sleutel")]
    return ranked(each.crossJoin(F.broadcast(top)), order).withColumn("valt_op", F.concat_ws(",", F.when(F.col("plek") == 1, "leider"), F.when((F.col("op_een") == F.col("mo")) & (F.col("mo") > 0), "op_een"), F.when(F.col("weken") == F.col("mw"), "langst"))).drop("mo", "mw")


def song_pages(entries: DataFrame) -> DataFrame:
    """For each song and chart: points over all rows, editions, peak, times at one, best year and years. Rows aren't deduped."""
    rows = entries.withColumn("lengte", F.max("positie").over(Window.partitionBy("lijst", "jaar", "week"))).withColumn("punten", F.col("lengte") - F.col("positie") + 1)
    year = rows.groupBy("sleutel", "lijst", "jaar").agg(F.sum("punten").alias("p"), F.count("*").alias("n"), F.min("positie").alias("h"), F.count_if(F.col("positie") == 1).alias("een"))
    return year.groupBy("sleutel", "lijst").agg(
        F.sum("p").alias("punten"), F.sum("n").alias("weken"), F.min("h").alias("hoogste"), F.sum("een").alias("op_een"), F.min_by("jaar", F.struct(-F.col("p"), F.col("jaar"))).alias("beste_jaar"),
        F.array_join(F.sort_array(F.collect_set("jaar")), ",").alias("jaren"),
    )


def artist_blocks(entries: DataFrame, top: int = 10) -> DataFrame:
    """(lijst, blok, plek, artiestsleutel, waarde): the artists with most songs, songs at one (zeros left out), weeks and points
    in each chart; points settle ties."""
    song = scored(entries).groupBy("lijst", "sleutel").agg(F.sum("punten").alias("p"), F.count("*").alias("w"), F.min("positie").alias("h"))
    each = song.groupBy("lijst", _artist().alias("artiestsleutel")).agg(F.count("*").alias("nummers"), F.count_if(F.col("h") == 1).alias("op_een"), F.sum("w").alias("weken"), F.sum("p").alias("punten"))
    blocks = each.select("lijst", "artiestsleutel", F.col("punten").alias("p"), F.explode(F.create_map(*[x for b in ("nummers", "op_een", "weken", "punten") for x in (F.lit(b), F.col(b))])).alias("blok", "waarde"))
    order = Window.partitionBy("lijst", "blok").orderBy(F.desc("waarde"), F.desc("p"), "artiestsleutel")
    return blocks.where("waarde > 0").withColumn("plek", F.row_number().over(order)).where(F.col("plek") <= top).drop("p")


def chart_figures(entries: DataFrame) -> DataFrame:
    """Entries, songs, artists, editions and span of each chart."""
    return entries.groupBy("lijst").agg(
        F.count("*").alias("noteringen"), F.count_distinct("sleutel").alias("nummers"), F.count_distinct(_artist()).alias("artiesten"), F.count_distinct("jaar", "week").alias("edities"), F.min("jaar").alias("van"), F.max("jaar").alias("tot")
    )


def careers(entries: DataFrame, top: int = 10) -> DataFrame:
    """The artists with the longest careers in weekly charts: last charted year less the first."""
    each = entries.where(F.col("lijst").startswith("wk_")).groupBy(_artist().alias("artiestsleutel")).agg(F.min("jaar").alias("van"), F.max("jaar").alias("tot"), F.count_distinct("sleutel").alias("nummers"))
    return each.withColumn("jaren", F.col("tot") - F.col("van")).orderBy(F.desc("jaren"), F.desc("nummers"), "artiestsleutel").limit(top)


def week_report(source: DataFrame, chart: str, year: int, week: int) -> DataFrame:
    """(soort, sleutel, positie, sprong): number one, new songs, re-entries, the biggest climber and faller of an edition, and the
    songs of the edition before that are gone. source: entries with_source_columns."""
    rows = source.where(F.col("lijst") == chart)
    now = rows.where((F.col("jaar") == year) & (F.col("week") == week))
    step = (F.col("vorige_positie") - F.col("positie")).alias("sprong")
    kind = F.when(F.col("positie") == 1, F.array(F.lit("nummer_een"))).otherwise(F.array())
    kind = F.concat(kind, F.when(F.col("site_status").isin("nieuw", "terug"), F.array("site_status")).otherwise(F.array()))
    out = now.select(F.explode(kind).alias("soort"), "sleutel", "positie", step)
    moved = now.select("sleutel", "positie", step)
    for name, order, some in (("stijger", (F.desc("sprong"), "positie"), "sprong > 0"), ("daler", ("sprong", "positie"), "sprong < 0")):
        out = out.unionByName(moved.where(some).orderBy(*order, "sleutel").limit(1).select(F.lit(name).alias("soort"), "sleutel", "positie", "sprong"))
    before = now.select((F.col("idx") - 1).alias("idx")).distinct()
    gone = rows.join(before, "idx", "left_semi").join(now.select("sleutel"), "sleutel", "left_anti")
    return out.unionByName(gone.select(F.lit("uit").alias("soort"), "sleutel", "positie", F.lit(None).cast("int").alias("sprong")))


def other_charts(source: DataFrame, year: int, week: int) -> DataFrame:
    """Of each weekly chart's edition: entries, new ones, re-entries and the number one."""
    rows = source.where(F.col("lijst").startswith("wk_") & (F.col("jaar") == year) & (F.col("week") == week))
    return rows.groupBy("lijst").agg(F.count("*").alias("noteringen"), F.count_if(F.col("site_status") == "nieuw").alias("nieuw"), F.count_if(F.col("site_status") == "terug").alias("terug"), F.min_by("sleutel", "positie").alias("nummer_een"))


def new_songs(source: DataFrame, meaning: str) -> DataFrame:
    """Entries that are new, in one of three meanings: "jaar" - the song's first year in the chart; "week" - no position before and
    not a re-entry; "werkboek" - its first week of a year, and it wasn't in the chart the year before (in a chart's first year,
    its status in that chart's first week must say new or back)."""
    song = Window.partitionBy("lijst", "sleutel")
    if meaning == "jaar":
        rows = source.withColumn("eerste", F.min("jaar").over(song)).where("jaar = eerste")
    elif meaning == "week":
        rows = source.where((F.coalesce("vorige_positie", F.lit(0)) == 0) & (F.col("site_status") != "terug"))
    elif meaning == "werkboek":
        first = F.min("week").over(Window.partitionBy("lijst", "jaar", "sleutel"))
        years = source.select("lijst", "jaar", "sleutel").distinct()
        last = years.select("lijst", (F.col("jaar") + 1).alias("jaar"), "sleutel", F.lit(True).alias("vorig_jaar"))
        had = years.select("lijst", (F.col("jaar") + 1).alias("jaar")).distinct().withColumn("had", F.lit(True))
        chart = F.min("week").over(Window.partitionBy("lijst", "jaar"))
        rows = source.withColumn("eerste", first).withColumn("begin", chart).where("week = eerste")
        rows = rows.join(last, ["lijst", "jaar", "sleutel"], "left").join(had, ["lijst", "jaar"], "left")
        rows = rows.where(F.col("vorig_jaar").isNull() & (F.col("had").isNotNull() | (F.col("week") > F.col("begin")) | F.col("site_status").isin("nieuw", "terug")))
    else:
        raise ValueError(meaning)
    return rows.select("lijst", "jaar", "week", "positie", "sleutel")


def only_flagged(rows: DataFrame, *flags: DataFrame) -> DataFrame:
    """Rows whose key is in every one of the flag tables (sleutel)."""
    for f in flags:
        rows = rows.join(f.select("sleutel").distinct(), "sleutel", "left_semi")
    return rows


def filtered_artists(entries: DataFrame, flagged: DataFrame, at_least: int = 2, share: float = 0.25) -> DataFrame:
    """Artists with at least so many songs, of which at least that share is flagged, with the share."""
    songs = entries.select("sleutel", _artist().alias("artiestsleutel")).distinct()
    each = songs.join(flagged.select("sleutel").distinct().withColumn("f", F.lit(1)), "sleutel", "left").groupBy("artiestsleutel").agg(F.count("*").alias("nummers"), F.round(F.avg(F.coalesce("f", F.lit(0))), 6).alias("deel"))
    return each.where((F.col("nummers") >= at_least) & (F.col("deel") >= share))


def year_top(entries: DataFrame, top: int = 5) -> DataFrame:
    """The first `top` songs by points of each chart-year."""
    each = scored(entries).groupBy("lijst", "jaar", "sleutel").agg(F.sum("punten").alias("punten"), F.min("positie").alias("hoogste"))
    order = Window.partitionBy("lijst", "jaar").orderBy(F.desc("punten"), "hoogste", "sleutel")
    return each.withColumn("plek", F.row_number().over(order)).where(F.col("plek") <= top)


def top_with_marked(ranked: DataFrame, top: int, marked: str) -> DataFrame:
    """ranked(plek, sleutel, ...) -> its first `top` places, or as many as reach the marked key."""
    far = ranked.agg(F.greatest(F.lit(top), F.coalesce(F.max(F.when(F.col("sleutel") == marked, F.col("plek"))), F.lit(0))).alias("tot"))
    return ranked.join(F.broadcast(far), F.col("plek") <= F.col("tot")).drop("tot")


def weeks_merged(entries: DataFrame) -> DataFrame:
    """All weekly charts of a week in one: of each key the first entry by chart and position."""
    rows = entries.where(F.col("lijst").startswith("wk_"))
    first = F.row_number().over(Window.partitionBy("jaar", "week", "sleutel").orderBy("lijst", "positie"))
    return rows.withColumn("nr", first).where("nr = 1").select("jaar", "week", "lijst", "positie", "sleutel")


def song_series(entries: DataFrame, year: int) -> DataFrame:
    """(lijst, sleutel, jaar, week, positie, punten) of the songs of a year: every edition from the begin of the run that holds
    their first one of the year to the end of the run that holds the last one, without a position where they were absent."""
    span = run_span(entries, year).select("lijst", "sleutel", "begin_idx", "eind_idx")
    calendar = calendar_index(entries)
    every = span.select("lijst", "sleutel", F.explode(F.sequence("begin_idx", "eind_idx")).alias("idx")).join(calendar, ["lijst", "idx"])
    own = scored(entries).select("lijst", "jaar", "week", "sleutel", "positie", "punten")
    return every.join(own, ["lijst", "jaar", "week", "sleutel"], "left").select("lijst", "sleutel", "jaar", "week", "positie", "punten")


def edition_series(entries: DataFrame) -> DataFrame:
    """Of each song in an annual chart: its position in every edition from its first to its last one, null where absent."""
    seq = sequence(entries.where(F.col("lijst").startswith("jr_"))).select("lijst", "sleutel", "idx", "positie")
    span = seq.groupBy("lijst", "sleutel").agg(F.min("idx").alias("a"), F.max("idx").alias("z"))
    every = span.select("lijst", "sleutel", F.explode(F.sequence("a", "z")).alias("idx"))
    return every.join(seq, ["lijst", "sleutel", "idx"], "left")


def segments(entries: DataFrame) -> DataFrame:
    """(lijst, sleutel, jaar, stuk, begin_idx, eind_idx): the unbroken parts of a song's line, cut at the turn of the year."""
    seq = sequence(entries).select("lijst", "sleutel", "jaar", "idx")
    order = Window.partitionBy("lijst", "sleutel", "jaar").orderBy("idx")
    each = seq.withColumn("g", F.col("idx") - F.row_number().over(order)).groupBy("lijst", "sleutel", "jaar", "g").agg(F.min("idx").alias("begin_idx"), F.max("idx").alias("eind_idx"))
    return each.withColumn("stuk", F.row_number().over(Window.partitionBy("lijst", "sleutel", "jaar").orderBy("begin_idx"))).drop("g")


def days_in_history(days: DataFrame, years: int = 6, step: int = 1) -> DataFrame:
    """days(dag) -> (dag, terug, toen): that day so many years ago; 29 February falls on the 28th."""
    return days.select("dag", F.explode(F.sequence(F.lit(step), F.lit(years * step), F.lit(step))).alias("terug")).withColumn("toen", F.add_months("dag", -12 * F.col("terug")))


def last_weeks(entries: DataFrame) -> DataFrame:
    """The last edition of the last year of each chart."""
    return entries.groupBy("lijst").agg(F.max(F.struct("jaar", "week")).alias("z")).select("lijst", "z.jaar", "z.week")


def matrix_order(entries: DataFrame, chart: str, year: int) -> DataFrame:
    """The songs of a chart-year in the order of a matrix: peak, first week, title."""
    rows = best_positions(entries.where((F.col("lijst") == chart) & (F.col("jaar") == year)))
    each = rows.groupBy("sleutel").agg(F.min("positie").alias("hoogste"), F.min("week").alias("eerste_week"), F.max_by("titel", "week").alias("titel"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("week", "positie"))), lambda x: F.concat_ws(":", x["week"].cast("string"), x["positie"].cast("string"))), " ").alias("weken"))
    return ranked(each, [F.col("hoogste"), F.col("eerste_week"), F.lower("titel"), F.col("sleutel")])


def surprise(entries: DataFrame, seed: int) -> DataFrame:
    """One song, picked by a seeded hash of its key weighted by its entries: the largest u^(1/n)."""
    each = entries.groupBy("sleutel").agg(F.count("*").alias("n"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "sleutel")), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(2**48 + 1))
    return each.withColumn("w", F.log(u) / F.col("n")).orderBy(F.desc("w"), "sleutel").limit(1).select("sleutel", "n")
