"""Queries of chart pages: lists planted in the table pages and read again, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.sources import chart_pages
from podium.sources.entries import ENTRIES_SQL, archive, read_table, with_source_columns


def _first(cut: Column) -> Column:
    """An item of a FIRST page; long titles are cut, the label has them in full."""
    kind = F.concat(F.lit("top40-list__item"), F.expr("case when positie % 7 = 0 then ' hitrecord' when positie % 5 = 0 then ' dot' when positie % 11 = 0 then ' super' else '' end"))
    p = F.col("positie").cast("string")
    arrow = lambda c: F.concat(F.lit('<span class="h5">'), F.col("vorige_positie").cast("string"), F.lit(f' <i class="fa {c}"></i> '), p, F.lit("</span>"))
    entry = lambda t: F.concat(F.lit(f'<span class="h5 span-entry">{t}</span><span class="h5">'), p, F.lit("</span>"))
    s = F.col("site_status")
    rank = F.when(s == "nieuw", entry("NIEUW")).when(s == "terug", entry("RE-ENTRY")).when(s == "stijger", arrow("color-green")).when(s == "daler", arrow("color-red")).otherwise(F.concat(F.lit('<span class="h5">'), p, F.lit(" <span></span></span>")))
    shown = F.when(cut, F.concat(F.substring("titel", 1, 9), F.lit(".."))).otherwise(F.col("titel"))
    return F.concat(
        F.lit('<div class="'), kind, F.lit('"><div class="top40-list__item__info"><div class="number-block"><span>'), p,
        F.lit('</span></div><a aria-label="nummer '), F.col("artiest"), F.lit(" - "), F.col("titel"), F.lit('"><h2 class="h3">'), shown, F.lit("</h2></a><h3>"), F.col("artiest"),
        F.lit('</h3></div><div class="top40-list__item__controls--rank">'), rank, F.lit('</div><div class="top40-list__item__controls--weeks"><span>'), F.col("weken_genoteerd").cast("string"), F.lit("</span><span>weken</span></div></div>"),
    )


def _second() -> Column:
    icon = F.expr("case site_status when 'stijger' then 'up' when 'daler' then 'down' when 'gelijk' then 'same' else 'new' end")
    before = F.coalesce(F.col("vorige_positie").cast("string"), F.lit("-"))
    return F.concat(
        F.lit('<div class="entry"><div class="nummer dw">'), F.col("positie").cast("string"), F.lit('</div><div class="nummer dif"><img src="/dif/'), icon,
        F.lit('.png"/></div><div class="info"><span class="titel">'), F.col("titel"), F.lit('<span><img class="x"></span></span><span class="artiest">'), F.col("artiest"),
        F.lit(' <span class="label">(label &amp; zoon)</span></span><span class="history">Aantal Weken: '), F.col("weken_genoteerd").cast("string"), F.lit("&nbsp;Vorige week: "), before, F.lit("</span></div></div>"),
    )


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every weekly edition in a page of the table pages; weeks divisible by 13 tell another week."""
    e = with_source_columns(archive(spark, sf).where("lijst like 'wk@_%' escape '@'"))
    item = F.when(F.col("lijst") == "wk_R", _second()).otherwise(_first((F.length("titel") > 10) & (F.col("positie") % 2 == 0)))
    lists = e.groupBy("lijst", "jaar", "week").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("positie", item.alias("h")))), lambda x: x["h"]), "\n").alias("items"))
    n = read_table(spark, sf, "pages").count()
    lists = lists.withColumn("page_id", F.pmod(F.xxhash64("lijst", "jaar", "week"), F.lit(n)))
    head = F.concat(F.lit("<title>Lijst van week "), F.expr("case when week % 13 = 0 then week - 1 else week end").cast("string"), F.lit(", "), F.col("jaar").cast("string"), F.lit("</title>"))
    body = F.when(F.col("lijst") == "wk_R", F.concat(F.lit('<div id="list">'), "items", F.lit("</div>"))).otherwise(F.concat(F.lit('<div class="list__list">'), "items", F.lit('<div class="top40-list__item no-longer-listed"><h2>weg</h2></div></div>')))
    own = read_table(spark, sf, "pages").select("page_id", F.regexp_replace("html", r"(?is)<title>.*?</title>", "").alias("rest"))
    return lists.join(own, "page_id").select("page_id", "lijst", "jaar", "week", F.concat(head, body, "rest").alias("html"))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return chart_pages.read_chart_pages(_pages(spark, sf), ["wk_R"], ["wk_A"])[0].drop("page_id")


def _rejected(spark: SparkSession, sf: str) -> DataFrame:
    return chart_pages.read_chart_pages(_pages(spark, sf), ["wk_R"], ["wk_A"])[1].drop("page_id")


QUERIES = {
    "chart_page_rows": (
        _rows,
        f"with recursive {ENTRIES_SQL.strip()}, w as (select lijst, jaar, week, positie, titel, artiest, vorige_positie, site_status, weken_genoteerd from (select e.*, idx, lag(idx) over w voor, case when lag(idx) over w = idx - 1 then lag(positie) over w end vorige_positie, cast(row_number() over w as integer) weken_genoteerd, "
        "case when lag(idx) over w is null then 'nieuw' when lag(idx) over w <> idx - 1 then 'terug' when lag(positie) over w > positie then 'stijger' when lag(positie) over w < positie then 'daler' else 'gelijk' end site_status from e join cal using (lijst, jaar, week) where lijst like 'wk@_%' escape '@' window w as (partition by lijst, sleutel order by idx, positie))) "
        "select lijst, jaar, week, positie, titel, artiest, case when lijst = 'wk_R' then 'label & zoon' end label, weken_genoteerd, vorige_positie, site_status, lijst <> 'wk_R' and positie % 7 = 0 alarmschijf, case when lijst <> 'wk_A' or positie % 7 = 0 then 0 when positie % 5 = 0 then 1 when positie % 11 = 0 then 2 else 0 end stip, false kroon from w where week % 13 <> 0",
    ),
    "rejected_pages": (_rejected, f"with recursive {ENTRIES_SQL.strip()} select distinct lijst, jaar, week, 'andere week' fout from e where lijst like 'wk@_%' escape '@' and week % 13 = 0"),
}
