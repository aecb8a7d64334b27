"""From the spellings of an outside source to those of the archive: artists by levels, titles where their keys differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions import text

#: Articles that a source leaves out, in the order in which they are tried.
ARTICLES = ("The", "De", "Het")


def credit(artist: Column) -> Column:
    """An artist with the joins between names that an import writes."""
    return text.met_joins(text.comma_joins(text.x_joins(text.unify_credit(text.clean_text(artist)))))


def plain_title(title: Column) -> Column:
    return text.subtitle_in_parentheses(text.clean_text(title))


def loose(c: Column) -> Column:
    """Letters a-z and digits alone: without capitals, accents, blanks and punctuation."""
    return F.regexp_replace(text.bare(c), "[^a-z0-9]", "")


def _index(entries: DataFrame) -> DataFrame:
    """entries(artiest) -> (los boolean, vorm, naam): each spelling by itself, and by its loose form the one most used (then the first)."""
    used = entries.where("artiest is not null").groupBy("artiest").agg(F.count("*").alias("n"))
    shapes = used.select("artiest", "n", loose(F.col("artiest")).alias("vorm")).where("vorm != ''")
    most = shapes.groupBy("vorm").agg(F.min_by("artiest", F.struct(-F.col("n"), "artiest")).alias("naam"))
    return used.select(F.lit(False).alias("los"), F.col("artiest").alias("vorm"), F.col("artiest").alias("naam")).unionByName(most.select(F.lit(True).alias("los"), "vorm", "naam"))


def artist_bridge(source: DataFrame, entries: DataFrame, by_hand: DataFrame | None = None) -> DataFrame:
    """source(artiest), entries(artiest) -> (artiest, naam, trap), a row for each spelling of the source that isn't null.

    naam is how the archive writes it, by the first level that has an answer: 0 by_hand(artiest, naam); 1 the credit as an import
    would write it; 2 to 4 that with an article before it; 5 the same letters and digits, 6 with "The" before; else the credit
    itself, trap null. Of several archive spellings with the same letters the one most used counts, then the first by code point.
    All levels are looked up in one join. Names without any of a-z and 0-9 have no loose form.
    """
    names = source.select("artiest").where("artiest is not null").distinct().withColumn("kaal", credit(F.col("artiest")))
    kaal, the = F.col("kaal"), F.concat(F.lit("The "), F.col("kaal"))
    ask = [(1, False, kaal), *((i + 2, False, F.concat(F.lit(x + " "), kaal)) for i, x in enumerate(ARTICLES)), (5, True, loose(kaal)), (6, True, loose(the))]
    each = names.select("artiest", "kaal", F.explode(F.array(*[F.struct(F.lit(r).alias("trap"), F.lit(los).alias("los"), c.alias("vorm")) for r, los, c in ask])).alias("v"))
    met = each.select("artiest", "v.*").join(_index(entries), ["los", "vorm"]).select("artiest", "naam", "trap")
    if by_hand is not None:
        fixed = by_hand.where("naam is not null").groupBy("artiest").agg(F.min("naam").alias("naam"))
        met = met.unionByName(names.select("artiest").join(fixed, "artiest").select("artiest", "naam", F.lit(0).alias("trap")))
    best = met.groupBy("artiest").agg(F.min_by("naam", "trap").alias("naam"), F.min("trap").alias("trap"))
    return names.join(best, "artiest", "left").select("artiest", F.coalesce("naam", "kaal").alias("naam"), "trap")


def title_bridge(source: DataFrame, entries: DataFrame, artists: DataFrame, per_title: DataFrame | None = None, by_hand: DataFrame | None = None) -> DataFrame:
    """source(artiest, titel), entries(artiest, titel), artists of artist_bridge -> (artiest, titel, wordt): titles that the archive
    writes otherwise. artiest is the archive's, by per_title(artiest, titel, naam) where that names the source's pair.

    A title is replaced only if its key isn't in the archive, but that of another title of the artist with the same letters and digits is
    (of several the first by code point): a live version stays a song of its own. by_hand(artiest, titel, wordt) comes before.
    Rows with a null are left out.
    """
    pairs = source.select("artiest", "titel").where("artiest is not null and titel is not null").distinct().join(artists.select("artiest", "naam"), "artiest", "left")
    if per_title is not None:
        fixed = per_title.groupBy("artiest", "titel").agg(F.min("naam").alias("vast"))
        pairs = pairs.join(fixed, ["artiest", "titel"], "left").withColumn("naam", F.coalesce("vast", "naam"))
    songs = pairs.select(F.coalesce("naam", "artiest").alias("naam"), "titel").distinct()
    songs = songs.withColumn("a", credit(F.col("naam"))).withColumn("t", plain_title(F.col("titel"))).withColumn("sleutel", text.song_key(F.col("a"), F.col("t")))
    known = entries.select("artiest", "titel").where("artiest is not null and titel is not null").distinct()
    keys = known.select(text.song_key(F.col("artiest"), F.col("titel")).alias("sleutel")).distinct()
    open_ = songs.join(keys, "sleutel", "left_anti").select("naam", "titel", "a", loose(F.col("t")).alias("los")).where("los != ''")
    same = known.withColumn("los", loose(F.col("titel"))).groupBy("artiest", "los").agg(F.min("titel").alias("wordt")).withColumnRenamed("artiest", "a")
    met = open_.join(same, ["a", "los"]).withColumn("sleutel", text.song_key(F.col("a"), plain_title(F.col("wordt"))))
    out = met.join(keys, "sleutel", "left_semi").select(F.col("naam").alias("artiest"), "titel", "wordt")
    if by_hand is None:
        return out
    fixed = by_hand.select("artiest", "titel", "wordt").where("wordt is not null").groupBy("artiest", "titel").agg(F.min("wordt").alias("wordt"))
    return out.join(fixed, ["artiest", "titel"], "left_anti").unionByName(fixed)


def bridged(source: DataFrame, artists: DataFrame, titles: DataFrame, per_title: DataFrame | None = None) -> DataFrame:
    """The rows of source, artiest and titel as the archive writes them; rows that the bridge doesn't know stay as they are."""
    out = source.join(artists.select("artiest", "naam"), "artiest", "left")
    if per_title is not None:
        out = out.join(per_title.groupBy("artiest", "titel").agg(F.min("naam").alias("vast")), ["artiest", "titel"], "left").withColumn("naam", F.coalesce("vast", "naam")).drop("vast")
    out = out.withColumn("artiest", F.coalesce("naam", "artiest")).drop("naam").join(titles, ["artiest", "titel"], "left")
    return out.withColumn("titel", F.coalesce("wordt", "titel")).select(*source.columns)
