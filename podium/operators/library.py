"""Songs matched with files of a media library, by levels: from the same key to alike names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.ratio import likeness
from podium.operators.similarity import near_pairs
from podium.sources.libraries import BRACKETS
from podium.sources.storage import written


def _artist(key: str) -> Column:
    return F.substring_index(key, "|", 1)


def _title(key: str) -> Column:
    return F.regexp_extract(key, r"(?s)^[^|]*\|(.*)$", 1)


def _words(c: str, least: int = 1) -> Column:
    return F.filter(F.split(c, " "), lambda w: F.length(w) >= least)


def _best(candidates: DataFrame) -> DataFrame:
    """candidates(sleutel, trap, keus, pad, streaming, bitrate) -> the best one of each key: least level and choice, local before
    streaming, highest bitrate, smallest path."""
    order = F.struct("trap", "keus", "streaming", (-F.col("bitrate")).alias("b"), "pad")
    return candidates.groupBy("sleutel").agg(F.min(order).alias("x")).select("sleutel", F.col("x.pad").alias("pad"), F.col("x.trap").alias("niveau"))


def match_library(songs: DataFrame, files: DataFrame, level: int = 2) -> DataFrame:
    """songs(sleutel), files(pad, sleutel, kern, streaming, bitrate) -> (sleutel, pad, niveau), one row for each key; both null where
    nothing fits.

    Level 1: the same key. 2: the same key without brackets, or else the same core title and all artists of one (between &)
    among those of the other. 3: the same core title and artists that are alike (0.6) or share a word. 4: core titles that
    share a word of 3 letters and are alike (0.85), and artists alike (0.5). The first level with a file counts; there local
    files come before streaming ones, then higher bitrates, then smaller paths. Null keys match nothing; a key counts once.

    Levels 1 to 3 are candidates of equi-joins; only songs left over go on to the next, and alike titles come from a join that
    makes no all-pairs (near_pairs). A core title of many files meets each song of that title once: that is the answer's own size.
    """
    s = songs.select("sleutel").where("sleutel is not null").distinct()
    s = s.withColumns({"artiest": _artist("sleutel"), "kern": F.concat(_artist("sleutel"), F.lit("|"), F.trim(F.regexp_replace(_title("sleutel"), BRACKETS, "")))})
    s = written(s.withColumn("titel", _title("kern")), "nummers")
    f = files.select("pad", F.col("sleutel").alias("fs"), F.col("kern").alias("fk"), "streaming", "bitrate").where("fs is not null and fk is not null")
    f = written(f.withColumns({"fa": _artist("fk"), "ft": _title("fk")}), "bestanden")
    of = ["pad", "streaming", "bitrate"]

    def level_of(met: DataFrame, trap: int, choice: int) -> DataFrame:
        return met.select("sleutel", F.lit(trap).alias("trap"), F.lit(choice).alias("keus"), *of)

    found = level_of(s.join(f, F.col("sleutel") == F.col("fs")), 1, 0)
    if level >= 2:
        found = found.unionByName(level_of(s.join(f, F.col("kern") == F.col("fk")), 2, 0))
    found = written(_best(found), "gevonden")
    if level >= 2:
        rest = s.join(found, "sleutel", "left_anti")
        parts = lambda c: F.split(c, " & ")
        within = (F.size(F.array_except(parts("artiest"), parts("fa"))) == 0) | (F.size(F.array_except(parts("fa"), parts("artiest"))) == 0)
        same = rest.join(f, F.col("titel") == F.col("ft"))
        found = written(found.unionByName(_best(level_of(same.where(within), 2, 1))), "gevonden")
    if level >= 3:
        rest = s.join(found, "sleutel", "left_anti")
        same = rest.join(f, F.col("titel") == F.col("ft"))
        share = F.arrays_overlap(_words("artiest"), _words("fa")) | (F.col("artiest") == F.col("fa"))
        alike = same.where(~share).withColumn("g", likeness(F.col("fa"), F.col("artiest"), 0.6)).where("g >= 0.6").drop("g")
        found = written(found.unionByName(_best(level_of(same.where(share).unionByName(alike), 3, 0))), "gevonden")
    if level >= 4:
        rest = written(s.join(found, "sleutel", "left_anti"), "over")
        wanted, had = rest.select(F.col("titel").alias("naam")).distinct(), f.select(F.col("ft").alias("naam")).distinct()
        pairs = near_pairs(wanted.unionByName(had), [], 0.85, 1_000_000)
        either = pairs.select(F.col("a").alias("titel"), F.col("b").alias("ft")).unionByName(pairs.select(F.col("b").alias("titel"), F.col("a").alias("ft")))
        either = either.join(wanted.withColumnRenamed("naam", "titel"), "titel", "left_semi").join(had.withColumnRenamed("naam", "ft"), "ft", "left_semi")
        near = either.where(F.arrays_overlap(_words("titel", 3), _words("ft", 3))).withColumn("g", likeness(F.col("ft"), F.col("titel"), 0.85)).where("g >= 0.85").drop("g")
        equal = wanted.select(F.col("naam").alias("titel"), F.col("naam").alias("ft")).where(F.size(_words("titel", 3)) > 0).join(had.withColumnRenamed("naam", "ft"), "ft", "left_semi")
        met = rest.join(near.unionByName(equal), "titel").join(f, "ft")
        met = met.withColumn("g", F.when(F.col("fa") == F.col("artiest"), F.lit(1.0)).otherwise(likeness(F.col("fa"), F.col("artiest"), 0.5))).where("g >= 0.5")
        found = found.unionByName(_best(level_of(met, 4, 0)))
    return s.select("sleutel").join(found, "sleutel", "left")
