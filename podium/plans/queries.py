"""All queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import text
from podium.operators import matching, points, reports, runs
from podium.plans import bridge_queries, chart_queries, clean_queries, edit_queries, ingest_queries, library_queries, page_queries, text_queries
from podium.sources.entries import ENTRIES_SQL, archive, chart_entries, read_table
from podium.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
CHART, YEAR = "wk_A", 1998
DAYS = [date(1996, 3, 1), date(1998, 2, 28), date(2000, 12, 31)]
ALIASES = [("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("x", "d"), ("z", "y")]


def _e(f: Callable[..., DataFrame], *args, **kw) -> Query:
    return lambda spark, sf: f(archive(spark, sf), *args, **kw)


def _sql(body: str) -> str:
    return f"with recursive {ENTRIES_SQL.strip()} {body}"


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    e = archive(spark, sf)
    o = points.year_ranking(e).where((F.col("lijst") == CHART) & (F.col("jaar") == YEAR) & (F.col("plek") <= 5))
    o = o.select("lijst", "jaar", "sleutel", F.lit(100).cast("long").alias("punten"), F.lit(2).alias("hoogste"), F.lit(7).cast("long").alias("weken"))
    return points.range_totals(e, 1997, 1999, o)


def _by_first_words(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with the first two words of the title as the artist, of whom many have one song."""
    t = F.lower("titel")
    return archive(spark, sf).withColumn("sleutel", F.concat(F.substring_index(t, " ", 2), F.lit("|"), t))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = archive(spark, sf).where("lijst like 'jr_%'")
    return e.groupBy("lijst", "sleutel").pivot("jaar", list(range(1995, 2002))).agg(F.min("positie")).fillna(0).select("lijst", "sleutel", *[F.col(str(y)).alias(f"p{y}") for y in range(1995, 2002)])


def _unpivot(spark: SparkSession, sf: str) -> DataFrame:
    years = [f"p{y}" for y in range(1995, 2002)]
    return _matrix(spark, sf).unpivot(["lijst", "sleutel"], years, "editie", "positie").where("positie > 0")


def _word_sets(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part").select("p_partkey", text.words(F.col("p_name")).alias("a"), text.words(F.col("p_type")).alias("b"))
    return p.select("p_partkey", F.size("a").cast("long").alias("n"), F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def _page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """A scan of source pages: the title of each, list items and links counted."""
    p = read_table(spark, sf, "pages")
    count = lambda x: F.regexp_count("html", F.lit(x)).cast("long")
    return p.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("titel"), count("<li>").alias("items"), count("<a href=").alias("links"))


_RANKS = "select lijst, jaar, sleutel, cast(sum(punten) as bigint) punten, min(positie) hoogste, count(*) weken, min(week) eerste_week, arg_max(titel, week) titel, arg_max(artiest, week) artiest from scored group by lijst, jaar, sleutel"
_PER_YEAR = "py as (select lijst, sleutel, jaar, cast(sum(punten) as bigint) eigen, min(positie) peak, count(*) n from scored where jaar between {a} and {b} group by all)"
_TOTALS = "select lijst, sleutel, cast(sum({p}) as bigint) punten, cast(sum({n}) as bigint) weken, min({h}) hoogste, arg_min(jaar, (-eigen, jaar)) beste_jaar, count(*) jaren from py {j} group by lijst, sleutel"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "chart_entries": (chart_entries, _sql("select * from e")),
    "week_chart": (_e(reports.week_chart, CHART, YEAR, 10), _sql(f"select positie, titel, artiest, sleutel from e where lijst = '{CHART}' and jaar = {YEAR} and week = 10")),
    "edition_length": (_e(points.edition_length), _sql("select * from len")),
    "best_positions": (_e(points.best_positions), _sql("select * from best")),
    "scored": (_e(points.scored), _sql("select lijst, jaar, week, sleutel, positie, titel, artiest, lengte, punten from scored")),
    "year_ranking": (_e(points.year_ranking), _sql(f"select *, cast(row_number() over (partition by lijst, jaar order by punten desc, hoogste, eerste_week, sleutel) as integer) plek from ({_RANKS})")),
    "range_totals": (_e(points.range_totals, 1996, 1999), _sql(f", {_PER_YEAR.format(a=1996, b=1999)} " + _TOTALS.format(p="eigen", n="n", h="peak", j=""))),
    "totals_with_overrides": (
        _overrides,
        _sql(
            f", {_PER_YEAR.format(a=1997, b=1999)}, ov as (select lijst, jaar, sleutel from (select *, row_number() over (partition by lijst, jaar order by punten desc, hoogste, eerste_week, sleutel) plek from ({_RANKS})) where plek <= 5 and lijst = '{CHART}' and jaar = {YEAR}), oj as (select py.*, ov.sleutel is not null o from py left join ov using (lijst, jaar, sleutel)) "
            "select lijst, sleutel, cast(sum(case when o then 100 else eigen end) as bigint) punten, cast(sum(case when o then 7 else n end) as bigint) weken, cast(min(case when o then 2 else peak end) as integer) hoogste, arg_min(jaar, (-eigen, jaar)) beste_jaar, count(*) jaren from oj group by lijst, sleutel"
        ),
    ),
    "decade_totals": (_e(points.decade_totals), _sql("select lijst, jaar - jaar % 10 decennium, sleutel, cast(sum(punten) as bigint) punten, count(*) weken, min(positie) hoogste from scored group by all")),
    "annual_combined": (
        _e(points.annual_combined),
        _sql(
            ", nr as (select e.*, lengte from e join len using (lijst, jaar, week) where lijst like 'jr@_%' escape '@'), pl as (select sleutel, lengte, sum(lengte - positie + 1) p from nr group by all), "
            "ps as (select sleutel, round_even(cast(sum(cast(round_even(p / lengte, 6) as decimal(20,6))) as double), 1) punten from pl group by sleutel) "
            "select ps.sleutel, ps.punten, count(*) noteringen, min(positie) hoogste, arg_min(jaar, (positie, jaar, lijst)) hoogste_jaar, count(distinct lijst) lijsten from nr join ps using (sleutel) group by ps.sleutel, ps.punten"
        ),
    ),
    "artist_ranking": (
        _e(points.artist_ranking),
        _sql("select split_part(sleutel, '|', 1) artiestsleutel, count(*) noteringen, count(distinct sleutel) nummers, count(distinct lijst) lijsten, count(*) filter (positie = 1 and lijst like 'wk@_%' escape '@') weken_op_een, min(jaar) eerste_jaar, max(jaar) laatste_jaar, max(artiest) artiest from e where split_part(sleutel, '|', 1) <> '' group by 1"),
    ),
    "calendar_index": (_e(runs.calendar_index), _sql("select * from cal")),
    "week_navigation": (
        _e(runs.week_navigation),
        _sql("select lijst, jaar, week, lag(jaar) over w vorige_jaar, lag(week) over w vorige_week, lead(jaar) over w volgende_jaar, lead(week) over w volgende_week from cal window w as (partition by lijst order by jaar, week)"),
    ),
    "runs": (_e(runs.runs), _sql("select * from runs")),
    "run_span_year": (
        _e(runs.run_span, YEAR),
        _sql(
            f", own as (select lijst, sleutel, min(idx) a, max(idx) z from seq where jaar = {YEAR} group by all), yr as (select lijst, min(idx) ya, max(idx) yz from cal where jaar = {YEAR} group by lijst) "
            "select o.lijst, o.sleutel, r1.begin_idx, r2.eind_idx, r1.begin_idx < ya begon_eerder, r2.eind_idx > yz loopt_door from own o join yr using (lijst) join runs r1 on r1.lijst = o.lijst and r1.sleutel = o.sleutel and o.a between r1.begin_idx and r1.eind_idx join runs r2 on r2.lijst = o.lijst and r2.sleutel = o.sleutel and o.z between r2.begin_idx and r2.eind_idx"
        ),
    ),
    "highest_entries": (_e(runs.highest_entries), _sql("select lijst, sleutel, min(eerste_positie) eerste_positie, arg_min(begin_idx, (eerste_positie, begin_idx)) begin_idx from runs where begin_idx > 1 group by lijst, sleutel")),
    "biggest_jumps": (
        _e(runs.biggest_jumps),
        _sql(", lg as (select *, lag(idx) over w pi, lag(positie) over w pp from seq window w as (partition by lijst, sleutel order by idx)) select lijst, sleutel, max(pp - positie) sprong, arg_max(idx, (pp - positie, idx)) idx from lg where pi = idx - 1 and pp > positie group by lijst, sleutel"),
    ),
    "climbs_to_one": (
        _e(runs.climbs_to_one),
        _sql(", f as (select lijst, sleutel, min(idx) een_idx from seq where positie = 1 group by all) select lijst, sleutel, een_idx, een_idx - begin_idx stappen from runs join f using (lijst, sleutel) where een_idx between begin_idx and eind_idx and een_idx > begin_idx"),
    ),
    "longest_absences": (
        _e(runs.longest_absences),
        _sql(", g as (select lijst, sleutel, idx, idx - lag(idx) over (partition by lijst, sleutel order by idx) stap from seq) select lijst, sleutel, max(stap) stap, arg_max(idx, (stap, idx)) idx from g where stap > 1 group by lijst, sleutel"),
    ),
    "comebacks": (
        _e(runs.comebacks),
        _sql(", y as (select distinct lijst, sleutel, jaar from e), g as (select *, lag(jaar) over (partition by lijst, sleutel order by jaar) vorig_jaar from y) select *, jaar - vorig_jaar jaren from g where jaar - vorig_jaar > 1 order by jaren desc, sleutel desc, lijst desc, jaar desc limit 10"),
    ),
    "waves": (
        _e(runs.waves),
        _sql(
            ", y as (select lijst, sleutel, jaar, count(*) n from e where lijst like 'wk@_%' escape '@' group by all), g as (select *, coalesce(jaar - lag(jaar) over (partition by lijst, sleutel order by jaar) >= 2, false) nw from y), w as (select *, sum(cast(nw as integer)) over (partition by lijst, sleutel order by jaar) golf from g), "
            "v as (select lijst, sleutel, cast(golf as bigint) golf, min(jaar) van, max(jaar) tot, cast(sum(n) as bigint) weken from w group by all) select * from (select *, count(*) over (partition by lijst, sleutel) golven from v) where golven >= 2"
        ),
    ),
    "delta_to_last": (_e(runs.delta_to_last), _sql("select lijst, sleutel, idx, positie, lag(positie) over (partition by lijst, sleutel order by idx) - positie verschil from seq")),
    "week_in_force": (
        lambda spark, sf: runs.week_in_force(archive(spark, sf), spark.createDataFrame([(d,) for d in DAYS], "dag date")),
        _sql(
            ", fr as (select lijst, jaar, week, make_date(jaar, 1, 1) + cast((6 - dayofweek(make_date(jaar, 1, 1)) + 7) % 7 as integer) + (week - 1) * 7 - 1 vrijdag from cal), dg as (select unnest([" + ", ".join(f"date '{d}'" for d in DAYS) + "]) dag) "
            "select l.lijst, dag, f.jaar, f.week from (select distinct lijst from e) l cross join dg left join lateral (select jaar, week from fr where fr.lijst = l.lijst and vrijdag <= dag order by vrijdag desc limit 1) f on true"
        ),
    ),
    "one_hit_wonders": (
        lambda spark, sf: reports.one_hit_wonders(_by_first_words(spark, sf)),
        _sql(", w as (select positie, split_part(lower(titel), ' ', 1) || ' ' || split_part(lower(titel), ' ', 2) || '|' || lower(titel) sleutel from e) select split_part(sleutel, '|', 1) artiestsleutel, max(sleutel) sleutel from w group by 1 having count(distinct sleutel) = 1 and min(positie) = 1"),
    ),
    "songs_per_artist": (
        _e(reports.songs_per_artist),
        _sql("select * from (select *, cast(row_number() over (partition by lijst order by nummers desc, noteringen desc, artiestsleutel) as integer) plek from (select lijst, split_part(sleutel, '|', 1) artiestsleutel, count(distinct sleutel) nummers, count(*) noteringen from e group by all)) where plek <= 10"),
    ),
    **{
        name: (
            _e(reports.longest_charted, one),
            _sql(f"select * from (select *, cast(row_number() over (partition by lijst order by weken desc, sleutel) as integer) plek from (select lijst, sleutel, count(distinct (jaar, week)) weken, min(positie) hoogste, min(jaar) van, max(jaar) tot from e {w} group by lijst, sleutel)) where plek <= 10"),
        )
        for name, one, w in (("longest_charted", False, ""), ("longest_at_one", True, "where positie = 1"))
    },
    "new_in_year": (_e(reports.new_in_year), _sql("select lijst, jaar, min(week) as week, sleutel from e group by lijst, jaar, sleutel")),
    "new_ever": (_e(reports.new_ever), _sql("select lijst, sleutel, min(jaar) jaar from e group by all")),
    "drop_outs": (
        _e(reports.drop_outs),
        _sql("select s.lijst, s.jaar, s.week, s.sleutel from seq s where s.idx < (select max(idx) from cal c where c.lijst = s.lijst) and not exists (select 1 from seq t where t.lijst = s.lijst and t.sleutel = s.sleutel and t.idx = s.idx + 1)"),
    ),
    "week_summary": (
        _e(reports.week_summary),
        _sql(
            ", o as (select *, lag(idx) over w ooit, case when lag(idx) over w = idx - 1 then lag(positie) over w end voor from seq window w as (partition by lijst, sleutel order by idx)) "
            "select lijst, jaar, week, arg_min(sleutel, (positie, sleutel)) nummer_een, count(*) nummers, count(*) filter (ooit is null) nieuw, count(*) filter (ooit is not null and voor is null) terug, max(voor - positie) filter (voor > positie) grootste_stijging, max(positie - voor) filter (voor < positie) grootste_daling from o group by lijst, jaar, week"
        ),
    ),
    "year_profile": (
        _e(reports.year_profile),
        _sql(", f as (select *, min(jaar) over (partition by lijst, sleutel) = jaar f from e) select lijst, jaar, count(distinct sleutel) nummers, count(*) noteringen, count(distinct case when positie = 1 then sleutel end) op_een, count(distinct case when f then sleutel end) eerste_keer from f group by lijst, jaar"),
    ),
    "compare_years": (_e(reports.compare_years, 1997, 1998), _sql("select a.lijst, a.sleutel, min(a.positie) positie_a, min(b.positie) positie_b from e a join e b using (lijst, sleutel) where a.jaar = 1997 and b.jaar = 1998 group by a.lijst, a.sleutel")),
    "chart_overview": (
        _e(reports.chart_overview),
        _sql("select lijst, min(jaar) van, max(jaar) tot, count(distinct jaar) jaren, count(*) edities, cast(sum(n) as bigint) noteringen, min(lengte) kortste, max(lengte) langste from (select lijst, jaar, week, max(positie) lengte, count(*) n from e group by all) group by lijst"),
    ),
    "edition_history": (
        _e(reports.edition_history),
        _sql(
            "select lijst, jaar, week, sleutel, positie, case when lag(idx) over w = idx - 1 then lag(positie) over w end vorige, lag(jaar) over w laatst, count(*) over (partition by lijst, sleutel order by idx rows unbounded preceding) edities, min(positie) over (partition by lijst, sleutel) beste "
            "from seq where lijst like 'jr@_%' escape '@' window w as (partition by lijst, sleutel order by idx)"
        ),
    ),
    "editions_list": (_e(reports.editions_list), _sql("select lijst, jaar, week, idx nr, count(*) over (partition by lijst, jaar) per_jaar from cal where lijst like 'jr@_%' escape '@'")),
    "title_families": (_e(reports.title_families), _sql("select split_part(sleutel, '|', 2) titelsleutel, count(distinct sleutel) versies, string_agg(distinct sleutel, ';' order by sleutel) leden from e group by 1 having count(distinct sleutel) >= 2")),
    "cross_reference": (_e(reports.cross_reference, "jr_F"), _sql("select lijst, count(distinct sleutel) nummers from e where lijst <> 'jr_F' and sleutel in (select sleutel from e where lijst = 'jr_F') group by lijst")),
    "artist_page": (_e(reports.artist_page, "brand 11"), _sql("select sleutel, count(*) noteringen, min(jaar) van, max(jaar) tot, min(positie) hoogste, string_agg(distinct lijst, ',' order by lijst) lijsten from e where starts_with(sleutel, 'brand 11|') group by sleutel")),
    **{
        name: (
            _e(reports.search, term, exact),
            _sql(f"select sleutel, lijst, count(*) noteringen, min(jaar) van, max(jaar) tot, min(positie) hoogste, arg_min(jaar, (positie, jaar)) piekjaar from e where {where} group by sleutel, lijst order by noteringen desc, sleutel, lijst limit 200"),
        )
        for name, term, exact, where in (
            ("search_contains", "a*1", False, "lower(titel) like '%a%1%' or lower(artiest) like '%a%1%'"),
            ("search_exact", "brand#11", True, "lower(titel) = 'brand#11' or lower(artiest) = 'brand#11'"),
            ("search_pipe", "brand#1| a", False, "lower(titel) like '% a%' and lower(artiest) like '%brand#1%'"),
        )
    },
    "missing_positions": (
        lambda spark, sf: reports.missing_positions(archive(spark, sf).where("positie % 7 != 0 or week % 2 = 0")),
        _sql(", h as (select * from e where positie % 7 != 0 or week % 2 = 0), m as (select lijst, jaar, week, unnest(range(1, max(positie) + 1)) p from h group by lijst, jaar, week) select lijst, jaar, week, count(*) n, string_agg(cast(p as varchar), ',' order by p) ontbreekt from m where not exists (select 1 from h where h.lijst = m.lijst and h.jaar = m.jaar and h.week = m.week and h.positie = m.p) group by lijst, jaar, week"),
    ),
    "missing_weeks": (
        lambda spark, sf: reports.missing_weeks(archive(spark, sf).where("week % 5 != 3")),
        _sql(", h as (select * from e where week % 5 != 3 and lijst like 'wk@_%' escape '@'), m as (select lijst, jaar, unnest(range(min(week), max(week) + 1)) as week from h group by lijst, jaar) select lijst, jaar, cast(week as integer) as week from m where not exists (select 1 from h where h.lijst = m.lijst and h.jaar = m.jaar and h.week = m.week)"),
    ),
    "shared_keys": (_e(reports.shared_keys), _sql("select lijst, jaar, week, sleutel, count(*) n from e group by all having count(*) > 1")),
    "mode_spelling": (_e(reports.mode_spelling), _sql("select artiestsleutel, max((n, artiest))[2] artiest, max(n) n from (select split_part(sleutel, '|', 1) artiestsleutel, artiest, count(*) n from e group by all) group by artiestsleutel")),
    "matrix_pivot": (_matrix, _sql("select lijst, sleutel, " + ", ".join(f"coalesce(min(positie) filter (jaar = {y}), 0) p{y}" for y in range(1995, 2002)) + " from e where lijst like 'jr@_%' escape '@' group by lijst, sleutel")),
    "matrix_unpivot": (_unpivot, _sql("select lijst, sleutel, 'p' || jaar editie, min(positie) positie from e where lijst like 'jr@_%' escape '@' group by all")),
    "alias_closure": (lambda spark, sf: matching.alias_closure(spark.createDataFrame(ALIASES, "van string, naar string")), "select * from (values ('a', 'c'), ('b', 'c'), ('d', 'd'), ('e', 'd'), ('x', 'd'), ('z', 'y')) t(van, eind)"),
    "word_sets": (_word_sets, "with w as (select p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 3)) a, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: length(x) >= 3)) b from part) select p_partkey, cast(len(a) as bigint) n, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) jaccard from w"),
    "page_titles": (_page_titles, "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) titel, cast(len(regexp_extract_all(html, '<li>')) as bigint) items, cast(len(regexp_extract_all(html, '<a href=')) as bigint) links from pages"),
    "event_windows": (
        lambda spark, sf: ev.windowed_counts(read_table(spark, sf, "events")).select("begin", "event_type", "n", F.round("total", 2).alias("total")),
        "select date_trunc('hour', ts) as begin, event_type, count(*) n, round(sum(value), 2) total from events group by all",
    ),
    "event_weekly_chart": (
        lambda spark, sf: ev.weekly_event_chart(read_table(spark, sf, "events")),
        "select * from (select *, cast(row_number() over (partition by event_type, week_van order by n desc, user_id) as integer) positie from (select event_type, cast(date_trunc('week', ts) as date) week_van, user_id, count(*) n from events group by all)) where positie <= 10",
    ),
    **text_queries.QUERIES,
    **chart_queries.QUERIES,
    **clean_queries.QUERIES,
    **library_queries.QUERIES,
    **ingest_queries.QUERIES,
    **page_queries.QUERIES,
    **edit_queries.QUERIES,
    **bridge_queries.QUERIES,
    # without an SQL twin: tests compare them with golden rows
    "normalised_keys": (lambda spark, sf: archive(spark, sf).select("artiest", "titel").distinct().select("artiest", "titel", text.song_key(F.col("artiest"), F.col("titel")).alias("sleutel")), None),
    "fuzzy_search": (_e(matching.fuzzy_search, "brand#12"), None),
    "similar_titles": (lambda spark, sf: matching.similar_pairs(read_table(spark, sf, "part").select(F.col("p_name").alias("naam")), 0.7), None),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}
