"""Queries of edits by hand, over logs made from the archive, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import edits
from podium.plans.text_queries import _norm, _re
from podium.sources.entries import ENTRIES_SQL, archive


def _key(artist: str, title: str) -> str:
    return f"{_re(_norm(artist, True), '^(?:the|de|het) ', '')} || '|' || {_norm(title, False)}"


def _songs(spark: SparkSession, sf: str) -> edits.Edited:
    """Songs whose title begins before c get another title, undone by a later edit where the artist ends in 1; those after r get a
    second artist."""
    e = archive(spark, sf)
    k = e.select("sleutel", "artiest", "titel").distinct()
    none = F.lit(None).cast("string")
    row = lambda d, n, a, t: d.select(F.lit(n).cast("long").alias("nr"), "sleutel", a.alias("artiest"), t.alias("titel"), F.lit(f"reden {n}").alias("reden"))
    log = row(k.where("titel < 'c'"), 1, none, F.concat("titel", F.lit(" (Remix)"))).unionByName(row(k.where("titel < 'c' and artiest like '%1'"), 2, none, F.col("titel")))
    return edits.correct_songs(e, log.unionByName(row(k.where("titel > 'r'"), 3, F.concat("artiest", F.lit(" feat. Gast")), none)))


_EDITED = (
    f"with recursive {ENTRIES_SQL.strip()}, m as (select *, case when titel < 'c' and artiest not like '%1' then titel || ' (Remix)' else titel end t, case when titel > 'r' then artiest || ' feat. Gast' else artiest end a, titel < 'c' or titel > 'r' raak, "
    "case when titel > 'r' then 3 when artiest like '%1' then 2 else 1 end nr from e), "
    f"n as (select *, case when raak then {_key('a', 't')} else sleutel end nieuw from m) "
)
QUERIES = {
    "corrected_songs": (lambda spark, sf: _songs(spark, sf).entries, _EDITED + "select lijst, jaar, week, positie, t titel, a artiest, nieuw sleutel from n"),
    "correction_aliases": (lambda spark, sf: _songs(spark, sf).aliases, _EDITED + "select distinct sleutel van, nieuw naar, 'reden ' || nr reden from n where nieuw <> sleutel"),
    "correction_audit": (
        lambda spark, sf: _songs(spark, sf).audit,
        _EDITED + "select distinct cast(nr as bigint) nr, 'correctie' soort, sleutel verwijst, 'artiest+titel' veld, artiest || ' - ' || titel oud, a || ' - ' || t nieuw, 'reden ' || nr reden from n where raak",
    ),
}
