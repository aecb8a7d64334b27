"""Sequences over the calendar of editions: runs, re-entries, jumps, absences, waves. All windows partition by chart or song."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from podium.operators.points import best_positions

_SONG = ("lijst", "sleutel")


def _by_idx() -> WindowSpec:
    return Window.partitionBy(*_SONG).orderBy("idx")


def calendar_index(entries: DataFrame) -> DataFrame:
    """The editions of each chart, numbered from 1 in time."""
    return entries.select("lijst", "jaar", "week").distinct().withColumn("idx", F.row_number().over(Window.partitionBy("lijst").orderBy("jaar", "week")))


def week_navigation(entries: DataFrame) -> DataFrame:
    """The edition before and after each edition, across years; null at the ends."""
    order = Window.partitionBy("lijst").orderBy("jaar", "week")
    days = entries.select("lijst", "jaar", "week").distinct()
    return days.select("lijst", "jaar", "week", *[f(c).over(order).alias(f"{n}_{c}") for n, f in (("vorige", F.lag), ("volgende", F.lead)) for c in ("jaar", "week")])


def sequence(entries: DataFrame) -> DataFrame:
    """best_positions with the edition's index. The calendar is small next to the entries; the optimizer picks the join."""
    return best_positions(entries).join(calendar_index(entries), ["lijst", "jaar", "week"])


def with_island(seq: DataFrame) -> DataFrame:
    """island: equal for editions that follow each other without a gap."""
    return seq.withColumn("island", F.col("idx") - F.row_number().over(_by_idx()))


def runs(entries: DataFrame) -> DataFrame:
    return with_island(sequence(entries)).groupBy(*_SONG, "island").agg(
        F.min("idx").alias("begin_idx"), F.max("idx").alias("eind_idx"), F.count("*").alias("weken"), F.min("positie").alias("hoogste"), F.min_by("positie", "idx").alias("eerste_positie")
    ).drop("island")


def run_edges(entries: DataFrame, years: list[int]) -> DataFrame:
    """For each song and each of the years (n: its place in the list, from 0): begin_n, the begin of the run that holds its first
    edition of the year, and eind_n, the end of the run that holds its last one, as indexes; vroeger_n and later_n: whether these
    lie outside the year. Null for a year without the song.

    One pass: editions are numbered in a song's own partition, shared places share a number, and what is asked of a run and of
    its song are aggregates there.
    """
    cal = calendar_index(entries)
    edges = [f(F.when(F.col("jaar") == y, F.col("idx"))).over(Window.partitionBy("lijst")).alias(f"{n}{k}") for k, y in enumerate(years) for n, f in (("ya", F.min), ("yz", F.max))]
    seq = entries.select("lijst", "jaar", "week", "sleutel").join(cal.select("*", *edges), ["lijst", "jaar", "week"])
    seq = seq.withColumn("island", F.col("idx") - F.dense_rank().over(_by_idx()))
    of = lambda k: F.when(F.col("jaar") == years[k], F.col("idx"))
    each = range(len(years))
    run = seq.groupBy(*_SONG, "island").agg(
        F.min("idx").alias("b"), F.max("idx").alias("e"), *[F.min(of(k)).alias(f"a{k}") for k in each], *[F.max(of(k)).alias(f"z{k}") for k in each], *[F.first(f"{n}{k}").alias(f"{n}{k}") for k in each for n in ("ya", "yz")]
    )
    song = run.groupBy(*_SONG).agg(*[x for k in each for x in (F.min_by("b", f"a{k}").alias(f"begin_{k}"), F.max_by("e", f"z{k}").alias(f"eind_{k}"), F.first(f"ya{k}").alias(f"ya{k}"), F.first(f"yz{k}").alias(f"yz{k}"))])
    return song.select(*_SONG, *[x for k in each for x in (f"begin_{k}", f"eind_{k}", (F.col(f"begin_{k}") < F.col(f"ya{k}")).alias(f"vroeger_{k}"), (F.col(f"eind_{k}") > F.col(f"yz{k}")).alias(f"later_{k}"))])


def run_span(entries: DataFrame, year: int) -> DataFrame:
    """For songs charted in a year: the begin of the run that holds their first edition of the year and the end of the run that
    holds the last one, as indexes, and whether these lie outside the year."""
    own = run_edges(entries, [year]).where("begin_0 is not null")
    return own.select(*_SONG, F.col("begin_0").alias("begin_idx"), F.col("eind_0").alias("eind_idx"), F.col("vroeger_0").alias("begon_eerder"), F.col("later_0").alias("loopt_door"))


def highest_entries(entries: DataFrame) -> DataFrame:
    """The best position at the start of a run, the earliest on ties; the chart's first edition doesn't count."""
    start = runs(entries).where("begin_idx > 1")
    return start.groupBy(*_SONG).agg(F.min(F.struct("eerste_positie", "begin_idx")).alias("m")).select(*_SONG, "m.eerste_positie", "m.begin_idx")


def biggest_jumps(entries: DataFrame) -> DataFrame:
    """The largest rise between editions that follow each other, above zero, the latest on ties."""
    seq = sequence(entries).select(*_SONG, "idx", "positie", F.lag("idx").over(_by_idx()).alias("pi"), F.lag("positie").over(_by_idx()).alias("pp"))
    rise = seq.where("pi = idx - 1 and pp > positie").withColumn("sprong", F.col("pp") - F.col("positie"))
    return rise.groupBy(*_SONG).agg(F.max(F.struct("sprong", "idx")).alias("m")).select(*_SONG, "m.sprong", "m.idx")


def climbs_to_one(entries: DataFrame) -> DataFrame:
    """Editions from the start of the run that holds the first number one up to it; direct number ones don't count."""
    isl = with_island(sequence(entries))
    first = isl.where("positie = 1").groupBy(*_SONG).agg(F.min("idx").alias("een_idx"))
    r = runs(entries).join(first, list(_SONG)).where("een_idx between begin_idx and eind_idx and een_idx > begin_idx")
    return r.select(*_SONG, "een_idx", (F.col("een_idx") - F.col("begin_idx")).alias("stappen"))


def longest_absences(entries: DataFrame) -> DataFrame:
    """The most editions between two runs of a song, the latest on ties."""
    gap = sequence(entries).select(*_SONG, "idx", (F.col("idx") - F.lag("idx").over(_by_idx())).alias("stap")).where("stap > 1")
    return gap.groupBy(*_SONG).agg(F.max(F.struct("stap", "idx")).alias("m")).select(*_SONG, "m.stap", "m.idx")


def comebacks(entries: DataFrame, top: int = 10) -> DataFrame:
    """The longest times in years between two charted years of a song in a chart."""
    years = entries.select(*_SONG, "jaar").distinct()
    before = F.lag("jaar").over(Window.partitionBy(*_SONG).orderBy("jaar"))
    gap = years.withColumn("vorig_jaar", before).where("jaar - vorig_jaar > 1").withColumn("jaren", F.col("jaar") - F.col("vorig_jaar"))
    return gap.orderBy(F.desc("jaren"), F.desc("sleutel"), F.desc("lijst"), F.desc("jaar")).limit(top)


def waves(entries: DataFrame, gap: int = 2) -> DataFrame:
    """Waves of a song in a weekly chart: a new one starts after a gap of `gap` years; songs with two waves or more."""
    years = entries.where(F.col("lijst").startswith("wk_")).groupBy(*_SONG, "jaar").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*_SONG).orderBy("jaar")
    new = F.coalesce((F.col("jaar") - F.lag("jaar").over(order) >= gap).cast("int"), F.lit(0))
    each = years.withColumn("new", new).withColumn("golf", F.sum("new").over(order)).groupBy(*_SONG, "golf").agg(F.min("jaar").alias("van"), F.max("jaar").alias("tot"), F.sum("n").alias("weken"))
    return each.withColumn("golven", F.count("*").over(Window.partitionBy(*_SONG))).where("golven >= 2")


def delta_to_last(entries: DataFrame) -> DataFrame:
    """Difference to the last charted position, over gaps; null for the first."""
    return sequence(entries).select(*_SONG, "idx", "positie", (F.lag("positie").over(_by_idx()) - F.col("positie")).alias("verschil"))


def friday(year: Column, week: Column) -> Column:
    """The Friday before the week-th Saturday of a year."""
    first = F.next_day(F.date_sub(F.make_date(year, F.lit(1), F.lit(1)), 1), "SAT")
    return F.date_add(first, (week - 1) * 7 - 1)


def week_in_force(entries: DataFrame, days: DataFrame) -> DataFrame:
    """days(dag) -> for each chart the last edition whose Friday is not after the day (as-of), null if none.

    Days and editions are lined up per chart and the last edition is carried forward; no theta join.
    """
    ed = entries.select("lijst", "jaar", "week").distinct().withColumn("dag", friday(F.col("jaar"), F.col("week")))
    lists = [r[0] for r in ed.select("lijst").distinct().orderBy("lijst").collect()]  # the chart catalogue
    asked = days.select("dag").distinct().withColumn("lijst", F.explode(F.array(*map(F.lit, lists))))
    both = ed.select("lijst", "dag", F.struct("jaar", "week").alias("ed"), F.lit(0).alias("vraag")).unionByName(asked.select("lijst", "dag", F.lit(None).alias("ed"), F.lit(1).alias("vraag")))
    last = F.last("ed", ignorenulls=True).over(Window.partitionBy("lijst").orderBy("dag", "vraag"))
    return both.withColumn("ed", last).where("vraag = 1").select("lijst", "dag", "ed.jaar", "ed.week")
