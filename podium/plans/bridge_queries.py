"""Queries of the spelling bridge, over an outside source made from the archive whose artists and titles are written otherwise there,
and of lines of a source that hold several songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import text
from podium.operators import bridge
from podium.plans.edit_queries import _key
from podium.sources.entries import ENTRIES_SQL, archive

_LAST = "right(artiest, 1)"
#: How the archive writes an artist, and how the source writes artists and titles.
_ARCHIVE = f"case when {_LAST} in ('1', '6') then 'The ' || artiest when {_LAST} = '2' then 'Het ' || artiest else artiest end"
_SOURCE = f"case when {_LAST} in ('3', '6') then lower(replace(artiest, '#', '')) when {_LAST} = '4' then artiest || ' feat. Gast' else artiest end"
_TITLE = f"case when {_LAST} in ('1', '5') then replace(titel, ' ', '') when {_LAST} = '7' then titel || ' (Live)' else titel || '!' end"


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = archive(spark, sf)
    return e.selectExpr(f"{_SOURCE} artiest", f"{_TITLE} titel", "lijst", "jaar", "positie"), e.withColumn("artiest", F.expr(_ARCHIVE))


def _artists(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.artist_bridge(*_both(spark, sf))


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    source, entries = _both(spark, sf)
    return bridge.title_bridge(source, entries, bridge.artist_bridge(source, entries))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    source, entries = _both(spark, sf)
    artists = bridge.artist_bridge(source, entries)
    out = bridge.bridged(source, artists, bridge.title_bridge(source, entries, artists))
    return out.groupBy("artiest", "titel").agg(F.count("*").alias("regels"), F.min("jaar").alias("eerste"))


def _shared(spark: SparkSession, sf: str) -> DataFrame:
    """Each three places of an edition as one line of a source, some titles with a part after a dash, back as songs."""
    e = archive(spark, sf).withColumn("titel", F.expr(_DASHED))
    of = e.groupBy("lijst", "jaar", "week", F.expr("(positie - 1) div 3").alias("rij")).agg(F.array_sort(F.collect_list(F.struct("positie", "sleutel", "artiest", "titel"))).alias("r"))
    line = F.concat(F.array_join("r.artiest", " / "), F.lit(" - "), F.array_join("r.titel", " / "))
    each = of.select("lijst", "jaar", "week", "rij", F.posexplode_outer(text.split_line(line)).alias("deel", "p"))
    return each.select("lijst", "jaar", "week", F.col("rij").cast("int").alias("rij"), "deel", "p.artiest", "p.titel")


_DASHED = "case when positie % 2 = 0 then titel || ' - Live' else titel end"
_SHARED_SQL = (
    f"with recursive {ENTRIES_SQL.strip()}, r as (select lijst, jaar, week, cast((positie - 1) // 3 as integer) rij, string_agg(artiest, ' / ' order by positie, sleutel, artiest) || ' - ' || string_agg({_DASHED}, ' / ' order by positie, sleutel, artiest) vol from e group by all), "
    "c as (select lijst, jaar, week, rij, unnest(range(1, len(string_split(vol, ' - ')))) i, string_split(vol, ' - ') d from r), "
    "s as (select lijst, jaar, week, rij, i, string_split(array_to_string(d[1:i], ' - '), ' / ') a, string_split(array_to_string(d[i + 1:], ' - '), ' / ') t from c), "
    "b as (select lijst, jaar, week, rij, arg_min(a, i) a, arg_min(t, i) t from s where len(a) = len(t) and len(a) > 1 group by all), "
    "x as (select lijst, jaar, week, rij, unnest(range(0, len(a))) k, a, t from b) "
    "select lijst, jaar, week, rij, cast(k as integer) deel, trim(a[k + 1]) artiest, trim(t[k + 1]) titel from x right join r using (lijst, jaar, week, rij)"
)
_LOOSE = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]', '', 'g')"
_ARTISTS_SQL = (
    f"with recursive {ENTRIES_SQL.strip()}, s as (select {_SOURCE} artiest, {_TITLE} titel, jaar from e), a as (select {_ARCHIVE} artiest, titel from e), "
    f"u as (select artiest, count(*) n from a group by 1), l as (select {_LOOSE.format('artiest')} vorm, arg_min(artiest, (-n, artiest)) naam from u group by 1), "
    "k as (select artiest, replace(artiest, ' feat. ', ' & ') kaal from (select distinct artiest from s)), "
    "b as (select k.artiest, coalesce(u1.artiest, u2.artiest, u3.artiest, u4.artiest, l5.naam, l6.naam, kaal) naam, "
    "cast(case when u1.n > 0 then 1 when u2.n > 0 then 2 when u3.n > 0 then 3 when u4.n > 0 then 4 when l5.naam <> '' then 5 when l6.naam <> '' then 6 end as integer) trap from k "
    "left join u u1 on u1.artiest = kaal left join u u2 on u2.artiest = 'The ' || kaal left join u u3 on u3.artiest = 'De ' || kaal left join u u4 on u4.artiest = 'Het ' || kaal "
    f"left join l l5 on l5.vorm = {_LOOSE.format('kaal')} left join l l6 on l6.vorm = 'the' || {_LOOSE.format('kaal')}) "
)
_TITLES_SQL = (
    _ARTISTS_SQL + f", p as (select distinct naam artiest, titel from s join b using (artiest)), keys as (select distinct {_key('artiest', 'titel')} sleutel from a), "
    f"o as (select artiest, titel, {_LOOSE.format('titel')} los from (select *, {_key('artiest', 'titel')} sleutel from p) where sleutel not in (from keys)), "
    f"z as (select artiest, {_LOOSE.format('titel')} los, min(titel) wordt from a group by all), t as (select artiest, titel, wordt from o join z using (artiest, los)) "
)
QUERIES = {
    "shared_lines": (_shared, _SHARED_SQL),
    "bridge_artists": (_artists, _ARTISTS_SQL + "select artiest, naam, trap from b"),
    "bridge_titles": (_titles, _TITLES_SQL + "select artiest, titel, wordt from t"),
    "bridged_source": (
        _rows,
        _TITLES_SQL + "select artiest, coalesce(wordt, titel) titel, count(*) regels, min(jaar) eerste from (select naam artiest, titel, jaar from s join b using (artiest)) left join t using (artiest, titel) group by all",
    ),
}
