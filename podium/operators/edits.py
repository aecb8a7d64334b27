"""Edits by hand as a log: songs corrected as a whole, single entries by place; keys, aliases, names and an audit follow."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions import text

_PLACE = ["lijst", "jaar", "week", "positie"]


class Edited(NamedTuple):
    """The entries after a log of edits, and what goes with them: aliases(van, naar, reden), artist_names(sleutel, naam) and
    title_names(sleutel, naam) fixed by hand, audit(nr, soort, verwijst, veld, oud, nieuw, reden), dirty(lijst, jaar)."""

    entries: DataFrame
    aliases: DataFrame
    artist_names: DataFrame
    title_names: DataFrame
    audit: DataFrame
    dirty: DataFrame


def _last(log: DataFrame, by: list[str]) -> DataFrame:
    """For each key the last artist and title that the log sets, each on its own; nr and reden of the last edit."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("nr")))
    return log.groupBy(*by).agg(last("artiest").alias("na"), last("titel").alias("nt"), F.max("nr").alias("nr"), F.max_by("reden", "nr").alias("reden"))


def correct_songs(entries: DataFrame, log: DataFrame) -> Edited:
    """log(nr, sleutel, artiest, titel, reden): the artist and title of whole songs, null: as it is. Of several edits of a song the last
    one of each field counts, whatever order the rows come in; edits of keys that no entry has do nothing.

    Every entry of the song gets the names and the key that follows from them. Where the key changes, an alias leads from the old
    one; the names set are fixed for the new key, so that later clean-ups keep them. A null field of an entry stays unless it is
    set. The same log once more changes nothing: the old keys are gone.
    """
    log = _last(log.where("sleutel is not null"), ["sleutel"]).where("na is not null or nt is not null")
    met = entries.join(log, "sleutel", "left")
    artist, title = F.coalesce("na", "artiest"), F.coalesce("nt", "titel")
    met = met.withColumns({"a": artist, "t": title, "geraakt": F.col("nr").isNotNull()})
    met = met.withColumn("nieuw", F.when(F.col("geraakt"), F.coalesce(text.song_key(F.col("a"), F.col("t")), F.col("sleutel"))).otherwise(F.col("sleutel")))
    hit = met.where("geraakt")
    out = met.select(*[{"artiest": F.col("a"), "titel": F.col("t"), "sleutel": F.col("nieuw")}.get(c, F.col(c)).alias(c) for c in entries.columns])
    # one row a song: the spelling of its first entry stands for what it was
    song = hit.groupBy("sleutel", "nr", "reden", "na", "nt").agg(F.min(F.struct(*_PLACE, "artiest", "titel", "a", "t", "nieuw")).alias("x")).select("sleutel", "nr", "reden", "na", "nt", "x.artiest", "x.titel", "x.a", "x.t", "x.nieuw")
    name = lambda x, y: F.concat_ws(" - ", x, y)
    return Edited(
        out,
        hit.where("nieuw <> sleutel").select(F.col("sleutel").alias("van"), F.col("nieuw").alias("naar"), "reden").distinct(),
        hit.where("na is not null").select(F.substring_index("nieuw", "|", 1).alias("sleutel"), F.col("na").alias("naam")).distinct(),
        hit.where("nt is not null").select(F.col("nieuw").alias("sleutel"), F.col("nt").alias("naam")).distinct(),
        song.select("nr", F.lit("correctie").alias("soort"), F.col("sleutel").alias("verwijst"), F.lit("artiest+titel").alias("veld"), name("artiest", "titel").alias("oud"), name("a", "t").alias("nieuw"), "reden"),
        hit.select("lijst", "jaar").distinct(),
    )


def edit_entries(entries: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log(nr, lijst, jaar, week, positie, sleutel, artiest, titel, reden) -> (entries, audit(nr, lijst, jaar, week, positie, sleutel, veld,
    oud, nieuw, reden)): single entries, found by place and key; the last edit of each field counts. The key follows from artist
    and title. A reason must be there: edits without one do nothing."""
    where = [*_PLACE, "sleutel"]
    met = entries.join(_last(log.where("trim(reden) <> ''"), where), where, "left").withColumns({"a": F.coalesce("na", "artiest"), "t": F.coalesce("nt", "titel")})
    met = met.withColumn("geraakt", F.col("nr").isNotNull() & ~(F.col("a").eqNullSafe(F.col("artiest")) & F.col("t").eqNullSafe(F.col("titel"))))
    met = met.withColumn("nieuw", F.when(F.col("geraakt"), F.coalesce(text.song_key(F.col("a"), F.col("t")), F.col("sleutel"))).otherwise(F.col("sleutel")))
    out = met.select(*[{"artiest": F.col("a"), "titel": F.col("t"), "sleutel": F.col("nieuw")}.get(c, F.col(c)).alias(c) for c in entries.columns])
    fields = F.array(*[F.struct(F.lit(n).alias("veld"), F.col(o).alias("oud"), F.col(x).alias("nieuw")) for n, o, x in (("artiest", "artiest", "a"), ("titel", "titel", "t"), ("sleutel", "sleutel", "nieuw"))])
    audit = met.where("geraakt").select("nr", *where, F.explode(fields).alias("v"), "reden").where("not (v.oud <=> v.nieuw)")
    return out, audit.select("nr", *where, "v.veld", "v.oud", "v.nieuw", "reden")
