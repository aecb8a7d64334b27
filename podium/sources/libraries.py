"""Media libraries exported as XML: one row for each file, with keys to match songs by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import text
from podium.sources.storage import written

#: Endings of sound and picture files, and how paths of streaming catalogues begin.
SOUND = (".mp3", ".flac", ".wav", ".ogg", ".m4a", ".aac", ".aif", ".aiff", ".wma")
PICTURE = (".mp4", ".mkv", ".avi", ".vob", ".webm", ".mov")
STREAM, STREAM_PICTURE = "netsearch://", "netsearch://tdv"
#: Fixed value: a part of a title in round or square brackets.
BRACKETS = r"\s*[\(\[][^\)\]]*[\)\]]"

SONG = "_FilePath string, Tags struct<_Author string, _Title string>, Infos struct<_Bitrate string>, _fout string"
TRACK = "_Location string, _Artist string, _Name string, _BitRate string, _fout string"


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").schema(schema).option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_fout").load(path)


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for e in endings:
        found |= F.endswith(F.lower(path), F.lit(e))
    return found


def _whole(number: Column) -> Column:
    return F.coalesce(F.try_to_number(F.trim(number), F.lit("9999999")).cast("int"), F.lit(0))


def core_key(artist: Column, title: Column) -> Column:
    """The key of a song without the parts of its title in brackets."""
    return text.song_key(artist, F.regexp_replace(title, BRACKETS, ""))


def _files(rows: DataFrame) -> DataFrame:
    there = rows.where((F.col("artiest") != "") & (F.col("titel") != ""))
    keys = {"sleutel": text.song_key(F.col("artiest"), F.col("titel")), "kern": core_key(F.col("artiest"), F.col("titel"))}
    return there.withColumns(keys).select("pad", "artiest", "titel", "bitrate", "streaming", "video", "sleutel", "kern")


def read_song_library(spark: SparkSession, path: str) -> DataFrame:
    """Song elements of one file or many -> (pad, artiest, titel, bitrate, streaming, video, sleutel, kern).

    Local files with an ending of SOUND or PICTURE and songs of a streaming catalogue stay, if artist and title aren't blank.
    A bitrate that is no number is 0. Elements that can't be read are left out; rejected_songs tells them. Files are split by
    elements, so a library of any size is read by many tasks, and document types with entities aren't expanded.
    """
    rows = _rows(spark, path, "Song", SONG).where("_fout is null")
    place = F.coalesce("_FilePath", F.lit(""))
    streaming = F.startswith(place, F.lit(STREAM))
    local = _ends(place, SOUND + PICTURE) & ~F.contains(place, F.lit("://"))
    named = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return _files(
        rows.where(local | streaming).select(
            place.alias("pad"),
            named(F.col("Tags._Author")).alias("artiest"),
            named(F.col("Tags._Title")).alias("titel"),
            _whole(F.col("Infos._Bitrate")).alias("bitrate"),
            streaming.alias("streaming"),
            (_ends(place, PICTURE) | F.startswith(place, F.lit(STREAM_PICTURE))).alias("video"),
        )
    )


def file_path(url: Column) -> Column:
    """The path of a file URL, decoded: file://localhost/C:/A%20B.mp3 -> C:/A B.mp3. A plus stays one; what can't be decoded
    stays as it is."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(plain, r"^/(?=.:)", "")


def read_track_library(spark: SparkSession, path: str) -> DataFrame:
    """TRACK elements with a file URL -> the same columns; nothing in such a library is streamed. Tracks without a place (those of
    playlists), of other endings or without artist or title are left out."""
    rows = _rows(spark, path, "TRACK", TRACK).where("_fout is null and _Location <> ''").withColumn("pad", file_path(F.col("_Location")))
    named = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return _files(
        rows.where(_ends(F.col("pad"), SOUND + PICTURE)).select(
            "pad", named(F.col("_Artist")).alias("artiest"), named(F.col("_Name")).alias("titel"), _whole(F.col("_BitRate")).alias("bitrate"),
            F.lit(False).alias("streaming"), _ends(F.col("pad"), PICTURE).alias("video"),
        )
    )


def rejected_songs(spark: SparkSession, path: str, tag: str = "Song") -> DataFrame:
    """The elements that can't be read, as they stand: (bestand, element)."""
    schema = SONG if tag == "Song" else TRACK
    # written first: Spark doesn't read this column alone
    return written(_rows(spark, path, tag, schema).withColumn("bestand", F.col("_metadata.file_path")), "elementen").where("_fout is not null").select("bestand", F.col("_fout").alias("element"))


def write_song_library(files: DataFrame, path: str) -> None:
    """files(pad, artiest, titel, bitrate) as XML that read_song_library reads."""
    tags = F.struct(F.col("artiest").alias("_Author"), F.col("titel").alias("_Title"))
    songs = files.select(F.col("pad").alias("_FilePath"), tags.alias("Tags"), F.struct(F.col("bitrate").cast("string").alias("_Bitrate")).alias("Infos"))
    songs.write.format("xml").option("rowTag", "Song").option("rootTag", "Library").save(path)
