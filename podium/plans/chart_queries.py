"""Queries of full rankings, series, filters and reports, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import rankings
from podium.sources.entries import ENTRIES_SQL, archive, with_source_columns

CHART, YEAR, WEEK = "wk_A", 1998, 10
DAYS = (date(1996, 2, 29), date(1998, 7, 4))


def _e(f, *args, **kw):
    return lambda spark, sf: f(archive(spark, sf), *args, **kw)


def _s(f, *args, **kw):
    return lambda spark, sf: f(with_source_columns(archive(spark, sf)), *args, **kw)


def _sql(body: str) -> str:
    return f"with recursive {ENTRIES_SQL.strip()} {body}"


def flags(entries: DataFrame) -> DataFrame:
    """A flag table: the keys with a title that begins with a to l."""
    return entries.where(F.substring("titel", 1, 1) < "m").select("sleutel").distinct()


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    e = archive(spark, sf)
    first = rankings.new_songs(with_source_columns(e), "jaar")
    return rankings.only_flagged(first, flags(e), e.where("positie = 1"))


def _language(spark: SparkSession, sf: str) -> DataFrame:
    e = archive(spark, sf)
    return e.join(flags(e), "sleutel").groupBy("lijst", "jaar").agg(F.count_distinct("sleutel").alias("nummers"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.top_with_marked(rankings.year_page(archive(spark, sf), CHART, YEAR).select("plek", "sleutel", "punten"), 20, _MARKED)


_MARKED = "brand 11|zzz"
_FL = "fl as (select distinct sleutel from e where substr(titel, 1, 1) < 'm')"
_FRI = "{0} + cast((6 - dayofweek({0}) + 7) % 7 as integer) + ({1} - 1) * 7 - 1"
_SPAN = (
    "own{y} as (select lijst, sleutel, min(idx) a, max(idx) z from seq where jaar = {y} group by all), yr{y} as (select lijst, min(idx) ya, max(idx) yz from cal where jaar = {y} group by lijst), "
    "span{y} as (select o.lijst, o.sleutel, r1.begin_idx, r2.eind_idx, r1.begin_idx < ya begon_eerder, r2.eind_idx > yz loopt_door from own{y} o join yr{y} using (lijst) join runs r1 on r1.lijst = o.lijst and r1.sleutel = o.sleutel and o.a between r1.begin_idx and r1.eind_idx join runs r2 on r2.lijst = o.lijst and r2.sleutel = o.sleutel and o.z between r2.begin_idx and r2.eind_idx)"
)
_PAGE = f"(select sleutel, cast(sum(punten) as bigint) punten, min(positie) hoogste, count(*) weken, count(*) filter (positie = 1) op_een, min(week) eerste_week, max(week) laatste_week, arg_max(titel, week) titel, arg_max(artiest, week) artiest from scored where lijst = '{CHART}' and jaar = {YEAR} group by sleutel)"
_PLACE = "cast(row_number() over (order by punten desc, hoogste, eerste_week, lower(titel), sleutel) as integer) plek"
_NEW = {
    "jaar": "select lijst, jaar, week, positie, sleutel from (select *, min(jaar) over (partition by lijst, sleutel) f from e) where jaar = f",
    "week": "select lijst, jaar, week, positie, sleutel from src where coalesce(vorige_positie, 0) = 0 and site_status <> 'terug'",
    "werkboek": "select s.lijst, s.jaar, s.week, s.positie, s.sleutel from src s where s.week = (select min(week) from e where e.lijst = s.lijst and e.jaar = s.jaar and e.sleutel = s.sleutel) and not exists (select 1 from e p where p.lijst = s.lijst and p.sleutel = s.sleutel and p.jaar = s.jaar - 1) "
    "and (exists (select 1 from e h where h.lijst = s.lijst and h.jaar = s.jaar - 1) or s.week > (select min(week) from e b where b.lijst = s.lijst and b.jaar = s.jaar) or s.site_status in ('nieuw', 'terug'))",
}
_DAYS_SQL = "(select unnest([" + ", ".join(f"date '{d}'" for d in DAYS) + "]) dag)"
_REPORT = f"r as (select * from src where lijst = '{CHART}'), nu as (select *, vorige_positie - positie sprong from r where jaar = {YEAR} and week = {WEEK})"

QUERIES = {
    "full_totals": (
        _e(rankings.full_totals, 1996, 1999),
        _sql(
            f", {_SPAN.format(y=1996)}, {_SPAN.format(y=1999)}, py as (select lijst, sleutel, jaar, sum(punten) eigen, min(positie) peak, count(*) n from scored where jaar between 1996 and 1999 group by all), "
            "tt as (select lijst, sleutel, cast(sum(eigen) as bigint) punten, cast(sum(n) as bigint) weken, min(peak) hoogste, arg_min(jaar, (-eigen, jaar)) beste_jaar, count(*) jaren, string_agg(cast(jaar as varchar), ',' order by jaar) jaartallen from py group by lijst, sleutel), "
            "mm as (select lijst, sleutel, arg_max(titel, (jaar, week, positie)) titel, arg_max(artiest, (jaar, week, positie)) artiest, min((jaar, week)) a, max((jaar, week)) z from e where jaar between 1996 and 1999 group by lijst, sleutel) "
            f"select tt.*, titel, artiest, {_FRI.format('make_date(a[1], 1, 1)', 'a[2]')} eerste_dag, {_FRI.format('make_date(z[1], 1, 1)', 'z[2]')} laatste_dag, coalesce(x.begon_eerder, false) begon_eerder, coalesce(y.loopt_door, false) loopt_door "
            "from tt join mm using (lijst, sleutel) left join span1996 x using (lijst, sleutel) left join span1999 y using (lijst, sleutel)"
        ),
    ),
    "year_page": (
        _e(rankings.year_page, CHART, YEAR),
        _sql(f"select *, {_PLACE}, concat_ws(',', case when row_number() over (order by punten desc, hoogste, eerste_week, lower(titel), sleutel) = 1 then 'leider' end, case when op_een > 0 and op_een = max(op_een) over () then 'op_een' end, case when weken = max(weken) over () then 'langst' end) valt_op from {_PAGE}"),
    ),
    "song_pages": (
        _e(rankings.song_pages),
        _sql(", y as (select sleutel, lijst, jaar, sum(lengte - positie + 1) p, count(*) n, min(positie) h, count(*) filter (positie = 1) een from e join len using (lijst, jaar, week) group by all) select sleutel, lijst, cast(sum(p) as bigint) punten, cast(sum(n) as bigint) weken, min(h) hoogste, cast(sum(een) as bigint) op_een, arg_min(jaar, (-p, jaar)) beste_jaar, string_agg(cast(jaar as varchar), ',' order by jaar) jaren from y group by sleutel, lijst"),
    ),
    "artist_blocks": (
        _e(rankings.artist_blocks),
        _sql(
            ", sg as (select lijst, sleutel, sum(punten) p, count(*) w, min(positie) h from scored group by all), ar as (select lijst, split_part(sleutel, '|', 1) artiestsleutel, count(*) nummers, count(*) filter (h = 1) op_een, cast(sum(w) as bigint) weken, cast(sum(p) as bigint) punten from sg group by all), "
            "bl as (select lijst, artiestsleutel, punten p, unnest(['nummers', 'op_een', 'weken', 'punten']) blok, unnest([nummers, op_een, weken, punten]) waarde from ar) "
            "select lijst, artiestsleutel, blok, waarde, plek from (select *, cast(row_number() over (partition by lijst, blok order by waarde desc, p desc, artiestsleutel) as integer) plek from bl where waarde > 0) where plek <= 10"
        ),
    ),
    "chart_figures": (_e(rankings.chart_figures), _sql("select lijst, count(*) noteringen, count(distinct sleutel) nummers, count(distinct split_part(sleutel, '|', 1)) artiesten, count(distinct (jaar, week)) edities, min(jaar) van, max(jaar) tot from e group by lijst")),
    "careers": (_e(rankings.careers), _sql("select split_part(sleutel, '|', 1) artiestsleutel, min(jaar) van, max(jaar) tot, count(distinct sleutel) nummers, max(jaar) - min(jaar) jaren from e where lijst like 'wk@_%' escape '@' group by 1 order by jaren desc, nummers desc, artiestsleutel limit 10")),
    "source_columns": (_s(lambda s: s), _sql("select lijst, jaar, week, positie, titel, artiest, sleutel, idx, vorige_positie, site_status, weken_genoteerd from src")),
    "week_report": (
        _s(rankings.week_report, CHART, YEAR, WEEK),
        _sql(
            f", {_REPORT} select 'nummer_een' soort, sleutel, positie, sprong from nu where positie = 1 union all select site_status, sleutel, positie, sprong from nu where site_status in ('nieuw', 'terug') "
            "union all (select 'stijger', sleutel, positie, sprong from nu where sprong > 0 order by sprong desc, positie, sleutel limit 1) union all (select 'daler', sleutel, positie, sprong from nu where sprong < 0 order by sprong, positie, sleutel limit 1) "
            "union all select 'uit', sleutel, positie, null from r where idx = (select max(idx) - 1 from nu) and sleutel not in (select sleutel from nu)"
        ),
    ),
    "other_charts": (_s(rankings.other_charts, YEAR, WEEK), _sql(f"select lijst, count(*) noteringen, count(*) filter (site_status = 'nieuw') nieuw, count(*) filter (site_status = 'terug') terug, arg_min(sleutel, positie) nummer_een from src where lijst like 'wk@_%' escape '@' and jaar = {YEAR} and week = {WEEK} group by lijst")),
    **{f"new_songs_{m}": (_s(rankings.new_songs, m), _sql(q)) for m, q in _NEW.items()},
    "flagged_songs": (_flagged, _sql(f", {_FL} select lijst, jaar, week, positie, sleutel from ({_NEW['jaar']}) where sleutel in (select sleutel from fl) and sleutel in (select sleutel from e where positie = 1)")),
    "flagged_counts": (_language, _sql(f", {_FL} select lijst, jaar, count(distinct e.sleutel) nummers from e join fl on fl.sleutel = e.sleutel group by lijst, jaar")),
    "filtered_artists": (
        lambda spark, sf: rankings.filtered_artists(archive(spark, sf), flags(archive(spark, sf))),
        _sql(f", {_FL} select * from (select split_part(s.sleutel, '|', 1) artiestsleutel, count(*) nummers, round(avg(case when fl.sleutel is null then 0 else 1 end), 6) deel from (select distinct sleutel from e) s left join fl on fl.sleutel = s.sleutel group by 1) where nummers >= 2 and deel >= 0.25"),
    ),
    "year_top": (_e(rankings.year_top), _sql("select * from (select *, cast(row_number() over (partition by lijst, jaar order by punten desc, hoogste, sleutel) as integer) plek from (select lijst, jaar, sleutel, cast(sum(punten) as bigint) punten, min(positie) hoogste from scored group by all)) where plek <= 5")),
    "top_with_marked": (_ranked, _sql(f"select plek, sleutel, punten from (select *, {_PLACE} from {_PAGE}) where plek <= greatest(20, coalesce((select max(plek) from (select *, {_PLACE} from {_PAGE}) where sleutel = '{_MARKED}'), 0))")),
    "weeks_merged": (_e(rankings.weeks_merged), _sql("select jaar, week, lijst, positie, sleutel from (select *, row_number() over (partition by jaar, week, sleutel order by lijst, positie) nr from e where lijst like 'wk@_%' escape '@') where nr = 1")),
    "song_series": (_e(rankings.song_series, YEAR), _sql(f", {_SPAN.format(y=YEAR)} select s.lijst, s.sleutel, cal.jaar, cal.week, p.positie, p.punten from span{YEAR} s join cal on cal.lijst = s.lijst and cal.idx between s.begin_idx and s.eind_idx left join scored p on p.lijst = s.lijst and p.jaar = cal.jaar and p.week = cal.week and p.sleutel = s.sleutel")),
    "edition_series": (_e(rankings.edition_series), _sql("select s.lijst, s.sleutel, cal.idx, q.positie from (select lijst, sleutel, min(idx) a, max(idx) z from seq where lijst like 'jr@_%' escape '@' group by all) s join cal on cal.lijst = s.lijst and cal.idx between a and z left join seq q on q.lijst = s.lijst and q.sleutel = s.sleutel and q.idx = cal.idx")),
    "segments": (_e(rankings.segments), _sql("select lijst, sleutel, jaar, cast(min(idx) as integer) begin_idx, cast(max(idx) as integer) eind_idx, cast(row_number() over (partition by lijst, sleutel, jaar order by min(idx)) as integer) stuk from (select *, idx - row_number() over (partition by lijst, sleutel, jaar order by idx) g from seq) group by lijst, sleutel, jaar, g")),
    "days_in_history": (lambda spark, sf: rankings.days_in_history(spark.createDataFrame([(d,) for d in DAYS], "dag date")), f"select dag, terug, cast(dag - to_years(terug) as date) toen from {_DAYS_SQL}, (select unnest(range(1, 7))::integer terug)"),
    "last_weeks": (_e(rankings.last_weeks), _sql("select lijst, max((jaar, week))[1] jaar, max((jaar, week))[2] as week from e group by lijst")),
    "matrix_order": (_e(rankings.matrix_order, CHART, YEAR), _sql(f"select *, cast(row_number() over (order by hoogste, eerste_week, lower(titel), sleutel) as integer) plek from (select sleutel, min(positie) hoogste, min(week) eerste_week, arg_max(titel, week) titel, string_agg(week || ':' || positie, ' ' order by week) weken from best where lijst = '{CHART}' and jaar = {YEAR} group by sleutel)")),
    "surprise": (_e(rankings.surprise, 7), _sql("select sleutel, count(*) n from e group by sleutel order by ln((cast('0x' || substr(md5('7:' || sleutel), 1, 12) as bigint) + 1) / (2.0 ** 48 + 1)) / count(*) desc, sleutel limit 1")),
}
