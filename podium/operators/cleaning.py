"""Maintenance of an archive as functions from entries to entries, with what changed: spellings, keys, sides, names, flags.

A clean-up never changes rows in place: it returns the new rows; `changes` compares them with the old ones, and `dirty` names the
chart-years to write again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions import text
from podium.sources.storage import written

_ROW = ("lijst", "jaar", "week", "positie")


def accents(c: Column) -> Column:
    """Letters outside ASCII."""
    return F.length(F.regexp_replace(c, r"[\x00-\x7F]|\P{L}", ""))


def marks(c: Column) -> Column:
    """Commas, apostrophes, question and exclamation marks."""
    return F.length(F.regexp_replace(c, r"[^,'?!]", ""))


def elected_spellings(spellings: DataFrame, with_marks: bool = False) -> DataFrame:
    """spellings(sleutel, naam, n) -> (sleutel, naam): the one to keep. Names all in small letters don't count if there is
    another; then most letters outside ASCII, (for titles) most marks, then the most used, the first in order on ties."""
    each = spellings.withColumn("klein", F.col("naam") == F.lower("naam"))
    order = F.struct(~F.col("klein"), accents(F.col("naam")), (marks(F.col("naam")) if with_marks else F.lit(0)), "n")
    best = each.groupBy("sleutel").agg(F.max(order).alias("o"))
    of = each.withColumn("o", order).join(best, ["sleutel", "o"])
    return of.groupBy("sleutel").agg(F.min("naam").alias("naam"))


def title_spellings(entries: DataFrame) -> DataFrame:
    return entries.groupBy("sleutel", F.col("titel").alias("naam")).agg(F.count("*").alias("n"))


def artist_spellings(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.substring_index("sleutel", "|", 1).alias("sleutel"), F.col("artiest").alias("naam")).agg(F.count("*").alias("n"))


def variant_kinds(spellings: DataFrame, artists: bool) -> DataFrame:
    """spellings(sleutel, naam, n) with several names for a key -> (sleutel, vormen, soort): "tekens" if they differ in accents,
    capitals and source noise only, "lidwoord" (artists) if in a leading article too, else "anders"."""
    n = spellings.withColumn("kaal", text.bare(F.col("naam"))).withColumn("schoon", text.bare(text.without_source_noise(F.col("naam"))))
    n = n.withColumn("los", F.regexp_replace("kaal", "^(?:the|de|het) ", ""))
    each = n.groupBy("sleutel").agg(F.count_distinct("naam").alias("vormen"), *[F.count_distinct(c).alias(c) for c in ("kaal", "schoon", "los")]).where("vormen > 1")
    kind = F.when((F.col("kaal") == 1) | (F.col("schoon") == 1), "tekens")
    kind = kind.when(F.col("los") == 1, "lidwoord").otherwise("anders") if artists else kind.otherwise("anders")
    return each.select("sleutel", "vormen", kind.alias("soort"))


def spacing_variants(entries: DataFrame) -> DataFrame:
    """(sleutel, doel, titel): keys that are equal without blanks, and the one to keep - most blanks in its title, then most
    entries, then the first in order."""
    n = entries.groupBy("sleutel").agg(F.max("titel").alias("titel"), F.count("*").alias("n")).withColumn("dicht", F.replace("sleutel", F.lit(" "), F.lit("")))
    blanks = F.length("titel") - F.length(F.replace("titel", F.lit(" "), F.lit("")))
    best = n.groupBy("dicht").agg(F.min(F.struct((-blanks).alias("b"), (-F.col("n")).alias("m"), "sleutel", "titel")).alias("d"), F.count("*").alias("k")).where("k > 1")
    return n.join(best, "dicht").where("sleutel != d.sleutel").select("sleutel", F.col("d.sleutel").alias("doel"), F.col("d.titel").alias("titel"))


def borrowed_capitals(entries: DataFrame) -> DataFrame:
    """(sleutel, titel, vorm): titles in small letters for which another entry has the same letters with capitals: its most used
    form, the first in order on ties."""
    forms = entries.groupBy("titel").agg(F.count("*").alias("n")).withColumn("laag", F.lower("titel"))
    best = forms.where("titel != laag").groupBy("laag").agg(F.min(F.struct((-F.col("n")).alias("m"), "titel")).alias("b"))
    small = entries.where(F.col("titel") == F.lower("titel")).select("sleutel", "titel").distinct()
    return small.join(best, small.titel == best.laag).select("sleutel", "titel", F.col("b.titel").alias("vorm"))


def apply_names(entries: DataFrame, artists: DataFrame, titles: DataFrame) -> DataFrame:
    """artists(sleutel = artist part, naam), titles(sleutel, naam): the canonical spellings replace those of the entries."""
    a = artists.select(F.col("sleutel").alias("deel"), F.col("naam").alias("an"))
    t = titles.select("sleutel", F.col("naam").alias("tn"))
    out = entries.withColumn("deel", F.substring_index("sleutel", "|", 1)).join(a, "deel", "left").join(t, "sleutel", "left")
    return out.withColumn("artiest", F.coalesce("an", "artiest")).withColumn("titel", F.coalesce("tn", "titel")).select(entries.columns)


def repaired_texts(entries: DataFrame) -> DataFrame:
    """Entries with cleaned artists and titles: marks, credits, guests, separators, subtitles."""
    names = entries.select("artiest", "titel").distinct()
    a, t = text.guest_from_title(text.unify_credit(text.clean_text(F.col("artiest"))), text.clean_text(F.col("titel")))
    names = written(names.select("artiest", "titel", a.alias("a"), t.alias("t")), "namen")
    for rule in (text.x_joins, text.comma_joins, text.met_joins):  # written in between: rules name their input several times
        names = written(names.withColumn("a", rule(F.col("a"))), "namen")
    names = names.withColumn("t", text.subtitle_in_parentheses(F.col("t")))
    out = entries.join(names, ["artiest", "titel"])
    return out.withColumn("artiest", F.col("a")).withColumn("titel", F.col("t")).select(entries.columns)


def rekeyed(entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Entries with keys made anew from artist and title; aliases(van, eind) are followed."""
    names = entries.select("artiest", "titel").distinct().withColumn("k", text.song_key(F.col("artiest"), F.col("titel")))
    if aliases is not None:
        names = names.join(aliases.select(F.col("van").alias("k"), "eind"), "k", "left").withColumn("k", F.coalesce("eind", "k")).drop("eind")
    return entries.join(names, ["artiest", "titel"]).withColumn("sleutel", F.col("k")).select(entries.columns)


def split_sides(entries: DataFrame, separator: str = " ; ") -> DataFrame:
    """Double sides become rows that share a position: parts of artist and title pair up if there are as many, else each title
    has the whole artist. Keys follow. Entries without the separator stay as they are, so a second run changes nothing."""
    double = F.contains("titel", F.lit(separator))
    each = entries.where(double).withColumn("kant", F.explode(text.split_sides(F.col("artiest"), F.col("titel"), separator)))
    made = each.withColumn("artiest", F.col("kant.artiest")).withColumn("titel", F.col("kant.titel")).select(entries.columns)
    return entries.where(~double).unionByName(rekeyed(made))


def split_versions(entries: DataFrame) -> DataFrame:
    """Two versions " / " on one place become two rows, if artist and title have as many parts and the acts differ."""
    n = lambda c: F.size(F.split(c, F.lit(" / ")))
    parts = F.split("artiest", F.lit(" / "))
    other = F.coalesce(~text.same_act(F.get(parts, 0), F.get(parts, 1)), F.lit(False))
    two = (n("titel") > 1) & (n("titel") == n("artiest")) & other
    marked = entries.withColumn("twee", two)
    made = marked.where("twee").withColumn("kant", F.explode(text.split_sides(F.col("artiest"), F.col("titel"), " / ")))
    made = made.withColumn("artiest", F.col("kant.artiest")).withColumn("titel", F.col("kant.titel")).select(entries.columns)
    return marked.where("not twee").select(entries.columns).unionByName(rekeyed(made))


def renamed(entries: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping(veld, oud, nieuw), field artiest or titel: exact names are replaced; keys follow where a name changed."""
    for field in ("artiest", "titel"):
        m = mapping.where(F.col("veld") == field).select(F.col("oud").alias(field), "nieuw")
        entries = entries.join(m, field, "left").withColumn("gewijzigd", F.col("nieuw").isNotNull()).withColumn(field, F.coalesce("nieuw", field)).drop("nieuw")
        entries = rekeyed(entries.where("gewijzigd").drop("gewijzigd")).unionByName(entries.where("not gewijzigd").drop("gewijzigd"), allowMissingColumns=True)
    return entries


def release_prefixes(entries: DataFrame) -> DataFrame:
    """(sleutel, titel, nummer): titles of the form "release : song"."""
    short = text.without_release(F.col("titel"))
    return entries.where(F.contains("titel", F.lit(" : ")) & (short != F.col("titel")) & (short != "")).select("sleutel", "titel", short.alias("nummer")).distinct()


def name_aliases(entries: DataFrame, artists: DataFrame) -> DataFrame:
    """artists(sleutel = artist part, naam) -> (van, naar): keys whose artist part isn't the key of its canonical name."""
    new = artists.select("sleutel", text.key_part(F.col("naam"), True).alias("nieuw")).where("sleutel != nieuw")
    keys = entries.select(F.col("sleutel").alias("van"), F.substring_index("sleutel", "|", 1).alias("sleutel")).distinct()
    return keys.join(new, "sleutel").select("van", F.concat("nieuw", F.lit("|"), F.substring_index("van", "|", -1)).alias("naar"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lijst, jaar, week, positie, veld, oud, nieuw): what a clean-up changed in entries that kept their place alone."""
    alone = lambda d, n: d.withColumn("k", F.count("*").over(Window.partitionBy(*_ROW))).where("k = 1").select(*_ROW, *[F.col(c).alias(f"{c}_{n}") for c in ("artiest", "titel", "sleutel")])
    both = alone(before, "oud").join(alone(after, "nieuw"), list(_ROW))
    fields = F.array(*[F.struct(F.lit(c).alias("veld"), F.col(f"{c}_oud").alias("oud"), F.col(f"{c}_nieuw").alias("nieuw")) for c in ("artiest", "titel", "sleutel")])
    return both.select(*_ROW, F.explode(fields).alias("v")).select(*_ROW, "v.*").where("not (oud <=> nieuw)")


def dirty(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lijst, jaar): the chart-years whose entries differ, by a sum of row hashes that doesn't depend on their order."""
    total = lambda d, n: d.groupBy("lijst", "jaar").agg(F.sum(F.xxhash64("week", "positie", "artiest", "titel", "sleutel").cast("decimal(38,0)")).alias(n))
    return total(before, "a").join(total(after, "b"), ["lijst", "jaar"], "full").where("not (a <=> b)").select("lijst", "jaar")


def cleaned(entries: DataFrame) -> DataFrame:
    """The clean-up in its order: texts, elected artist names, elected titles, sides, versions, keys."""
    out = rekeyed(repaired_texts(entries))
    out = apply_names(out, elected_spellings(artist_spellings(out)), elected_spellings(title_spellings(out), with_marks=True))
    return rekeyed(split_versions(split_sides(out)))


def language_flags(entries: DataFrame, proven: DataFrame, foreign: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """proven, foreign(sleutel): keys with evidence of their own -> (sleutel, nederlandstalig, bron). Evidence of a key counts
    first; the other keys of an artist follow if at least 2 are proven and they make 80 % of its proven and foreign ones.
    manual(sleutel, nederlandstalig) always wins."""
    keys = entries.select("sleutel", F.substring_index("sleutel", "|", 1).alias("deel")).distinct()
    yes, no = proven.select("sleutel").distinct().withColumn("ja", F.lit(1)), foreign.select("sleutel").distinct().withColumn("nee", F.lit(1))
    each = keys.join(yes, "sleutel", "left").join(no, "sleutel", "left").withColumn("nee", F.when(F.col("ja").isNull(), F.col("nee")))
    artist = each.groupBy("deel").agg(F.count("ja").alias("j"), F.count("nee").alias("n"))
    each = each.join(artist.where((F.col("j") >= 2) & (F.col("j") >= 0.8 * (F.col("j") + F.col("n")))).select("deel", F.lit(True).alias("artiest_ja")), "deel", "left")
    flag = F.when(F.col("ja") == 1, True).when(F.col("nee") == 1, False).otherwise(F.coalesce("artiest_ja", F.lit(False)))
    source = F.when((F.col("ja") == 1) | (F.col("nee") == 1), "titel").when(F.col("artiest_ja"), "artiest").otherwise("geen")
    out = each.select("sleutel", flag.alias("nederlandstalig"), source.alias("bron"))
    if manual is None:
        return out
    m = manual.select("sleutel", F.col("nederlandstalig").alias("hand"))
    return out.join(m, "sleutel", "left").select("sleutel", F.coalesce("hand", "nederlandstalig").alias("nederlandstalig"), F.when(F.col("hand").isNotNull(), "hand").otherwise(F.col("bron")).alias("bron"))
