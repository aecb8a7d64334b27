"""Queries over media libraries as XML, made from the table part, each with its SQL where SQL has it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import text
from podium.operators import library
from podium.plans.text_queries import _norm, _re
from podium.sources import libraries
from podium.sources.entries import ENTRIES_SQL, archive, read_table
from podium.sources.storage import shared_dir

#: What a library has of each part: guests, spelling mistakes, versions, streams and pictures, blanks and bad numbers.
_FILES = {
    "artiest": "case p_partkey % 7 when 2 then concat(p_brand, ' & Gast') when 3 then concat('Brnd', substr(p_brand, 6)) when 6 then ' ' else p_brand end",
    "titel": "case p_partkey % 5 when 1 then concat(p_name, ' (Live)') when 2 then replace(p_name, 'e', '') else p_name end",
    "pad": "concat(case p_partkey % 3 when 0 then 'netsearch://td' else 'C:/Muziek/' end, cast(p_partkey as varchar(12)), case p_partkey % 4 when 0 then '.mp4' when 1 then '.MP3' when 2 then '.txt' else '.flac' end)",
    "bitrate": "case p_partkey % 11 when 5 then '?' else cast(128 + 64 * (p_partkey % 4) as varchar(5)) end",
}


def _library(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/bibliotheek-{uuid.uuid4().hex}"
    part = read_table(spark, sf, "part")
    libraries.write_song_library(part.select(*[F.expr(e).alias(n) for n, e in _FILES.items()]), path)
    return libraries.read_song_library(spark, path)


def _songs(spark: SparkSession, sf: str) -> DataFrame:
    return archive(spark, sf).select("artiest", "titel").distinct().select(text.song_key(F.col("artiest"), F.col("titel")).alias("sleutel"))


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The same parts as tracks with file URLs."""
    path = f"{shared_dir(spark)}/tracks-{uuid.uuid4().hex}"
    part = read_table(spark, sf, "part")
    place = F.concat(F.lit("file://localhost/C:/M%20"), F.replace(F.url_encode("p_name"), F.lit("+"), F.lit("%20")), F.lit("+"), F.col("p_partkey").cast("string"), F.expr("case p_partkey % 3 when 0 then '.mp3' when 1 then '.doc' else '.mkv' end"))
    rows = part.select(F.when(F.col("p_partkey") % 13 > 0, place).alias("_Location"), F.col("p_brand").alias("_Artist"), F.col("p_name").alias("_Name"), (F.col("p_partkey") % 320).cast("string").alias("_BitRate"))
    rows.write.format("xml").option("rowTag", "TRACK").option("rootTag", "COLLECTION").save(path)
    return libraries.read_track_library(spark, path).select("pad", "artiest", "titel", "bitrate", "video")


def _key(artist: str, title: str) -> str:
    return f"{_re(_norm(artist, True), '^(?:the|de|het) ', '')} || '|' || {_norm(title, False)}"


_READ = (
    f"l as (select {', '.join(f'{e} {n}' for n, e in _FILES.items())} from part), "
    "lib as (select pad, trim(artiest) artiest, titel, coalesce(try_cast(bitrate as integer), 0) bitrate, starts_with(pad, 'netsearch://') streaming, ends_with(lower(pad), '.mp4') video, regexp_replace(titel, '\\s*[(\\[][^)\\]]*[)\\]]', '', 'g') kaal from l where trim(artiest) <> '' and (starts_with(pad, 'netsearch://') or not ends_with(pad, '.txt'))), "
    f"f as (select pad, artiest, titel, bitrate, streaming, video, {_key('artiest', 'titel')} sleutel, {_key('artiest', 'kaal')} kern from lib)"
)
_LEVELS = (
    f", {_READ}, n as (select distinct {_key('artiest', 'titel')} sleutel from e), s as (select sleutel, split_part(sleutel, '|', 1) a, split_part(sleutel, '|', 2) t from n), "
    "c as (select s.sleutel, pad, streaming, bitrate, 1 niveau, 0 keus from s join f on f.sleutel = s.sleutel union all select s.sleutel, pad, streaming, bitrate, 2, 0 from s join f on f.kern = s.sleutel "
    "union all select s.sleutel, pad, streaming, bitrate, 2, 1 from s join f on split_part(f.kern, '|', 2) = t where list_has_all(string_split(a, ' & '), string_split(split_part(f.kern, '|', 1), ' & ')) or list_has_all(string_split(split_part(f.kern, '|', 1), ' & '), string_split(a, ' & '))), "
    "b as (select sleutel, arg_min((pad, niveau), (niveau, keus, streaming, -bitrate, pad)) x from c group by sleutel) select s.sleutel, x[1] pad, x[2] niveau from s left join b using (sleutel)"
)

QUERIES = {
    "library_songs": (_library, f"with {_READ} select * from f"),
    "library_tracks": (
        _tracks,
        "select 'C:/M ' || p_name || '+' || p_partkey || case p_partkey % 3 when 0 then '.mp3' else '.mkv' end pad, p_brand artiest, p_name titel, cast(p_partkey % 320 as integer) bitrate, p_partkey % 3 = 2 video from part where p_partkey % 13 > 0 and p_partkey % 3 <> 1",
    ),
    "library_exact": (lambda spark, sf: library.match_library(_songs(spark, sf), _library(spark, sf), 2), f"with recursive {ENTRIES_SQL.strip()}{_LEVELS}"),
    # levels 3 and 4 need likeness; tests compare them with a plain loop
    "library_match": (lambda spark, sf: library.match_library(_songs(spark, sf), _library(spark, sf), 4), None),
}
