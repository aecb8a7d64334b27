"""Record linkage and closures: candidates come from equi-joins on blocks or words, similarity is computed on those only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions import text
from podium.functions.ratio import likeness
from podium.operators.similarity import contained_join, near_pairs, similar_join
from podium.sources.storage import written


def similar_pairs(names: DataFrame, least: float = 0.9, gap: int = 3) -> DataFrame:
    """names(naam) -> (a, b, gelijkenis) of all names that begin with the same two characters, are about as long and alike."""
    own = names.select("naam", F.substring("naam", 1, 2).alias("blok"))
    return similar_join(own, ["blok"], least, gap).select("a", "b", "gelijkenis")


def suspicious_pairs(entries: DataFrame, least: float = 0.9, gap: int = 12) -> DataFrame:
    """(lijst, jaar, a, b, score): all keys a < b of a chart-year of which titles and artists each lie one within the other, either
    way round (score 1; an empty title never does), or that differ by at most `gap` in length and are alike.

    Containment is joined on the titles by their rarest letters; likeness by similar_join. Neither loses a pair.
    """
    keys = entries.select("lijst", "jaar", "sleutel").where("sleutel is not null").distinct()
    artist, title = F.substring_index("sleutel", "|", 1), F.when(F.contains("sleutel", F.lit("|")), F.regexp_extract("sleutel", r"(?s)^[^|]*\|(.*)$", 1)).otherwise("")
    parts = written(keys.select("lijst", "jaar", "sleutel", artist.alias("ka"), title.alias("kt")), "delen")
    titles = contained_join(parts, ["lijst", "jaar"], "kt")
    of = lambda n, t: parts.select("lijst", "jaar", F.col("kt").alias(t), F.col("sleutel").alias(n), F.col("ka").alias(f"{n}_a"))
    met = titles.join(of("x", "klein"), ["lijst", "jaar", "klein"]).join(of("y", "groot"), ["lijst", "jaar", "groot"])
    within = F.contains("x_a", "y_a") | F.contains("y_a", "x_a")
    sure = met.where((F.col("x") != F.col("y")) & within).select("lijst", "jaar", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    near = similar_join(parts.select("lijst", "jaar", F.col("sleutel").alias("naam")), ["lijst", "jaar"], least, gap).join(sure, ["lijst", "jaar", "a", "b"], "left_anti")
    return sure.withColumn("score", F.lit(1.0)).unionByName(near.select("lijst", "jaar", "a", "b", text.rounded(F.col("gelijkenis"), 3).alias("score")))


def pair_verdicts(entries: DataFrame, pairs: DataFrame, apart: DataFrame | None = None, gap: int = 3) -> DataFrame:
    """pairs(lijst, jaar, a, b) -> with oordeel: "anders" if both stand in one week, "hernoemd" if at most `gap` whole weeks
    lie between the last week of one and the first of the other, else "los". apart(sleutel_a, sleutel_b): pairs known to be separate, either way round, are left out."""
    weeks = entries.groupBy("lijst", "jaar", "sleutel").agg(F.collect_set("week").alias("w"))
    if apart is not None:
        known = apart.select(F.least("sleutel_a", "sleutel_b").alias("a"), F.greatest("sleutel_a", "sleutel_b").alias("b"))
        pairs = pairs.join(known, ["a", "b"], "left_anti")
    of = lambda n: weeks.select("lijst", "jaar", F.col("sleutel").alias(n), F.col("w").alias(f"w{n}"))
    both = pairs.select("lijst", "jaar", "a", "b").join(of("a"), ["lijst", "jaar", "a"]).join(of("b"), ["lijst", "jaar", "b"])
    between = F.greatest(F.array_min("wa") - F.array_max("wb"), F.array_min("wb") - F.array_max("wa")) - 1
    verdict = F.when(F.arrays_overlap("wa", "wb"), "anders").when(between <= gap, "hernoemd").otherwise("los")
    return both.select("lijst", "jaar", "a", "b", verdict.alias("oordeel"))


def typo_proposals(entries: DataFrame, least: float = 0.9, rare: int = 8) -> DataFrame:
    """(a, b, gelijkenis, n_a, n_b): all artists a < b that look alike, of whom one has at most `rare` entries and the other
    at least as many, whatever they begin with and however long they are; those that only differ in a leading article are left out."""
    n = entries.groupBy("artiest").agg(F.count("*").alias("n"))
    pairs = similar_join(n.select(F.col("artiest").alias("naam")), [], least, 1_000_000)
    of = lambda c: n.select(F.col("artiest").alias(c), F.col("n").alias(f"n_{c}"))
    found = pairs.join(of("a"), "a").join(of("b"), "b")
    article = F.regexp_replace(F.lower("a"), "^the ", "") == F.regexp_replace(F.lower("b"), "^the ", "")
    return found.where((F.least("n_a", "n_b") <= rare) & (F.greatest("n_a", "n_b") >= rare) & ~article).select("a", "b", "gelijkenis", "n_a", "n_b")


def fuzzy_search(keys: DataFrame, term: str, least: float = 0.68, top: int = 200, field: str = "beide", word: float = 0.82) -> DataFrame:
    """keys(sleutel, artiest, titel) -> the `top` best matches of a term, all normalised; ties by key. field: artiest, titel or beide.

    1.0 if a field (beide: artist, title or both together) has the term; else the best likeness of a field to it, from `least`.
    A term of several words also matches word by word, for 0.95 of the weakest: each is 1 if equal to a word of the field, or, from
    4 letters on, part of one; else its best likeness to a word, from `word`. Terms under 3 letters find nothing; keys with
    several spellings are matched in each.
    """
    asked_for = keys.sparkSession.range(1).select(text.normalise(F.lit(term)).alias("t")).first()[0]
    out = keys.select("sleutel", "artiest", "titel").distinct()
    if len(asked_for) < 3:
        return out.where("false").withColumn("score", F.lit(0.0))
    found = out.withColumn("ka", text.normalise(F.coalesce("artiest", F.lit("")))).withColumn("kt", text.normalise(F.coalesce("titel", F.lit(""))))
    names = {"artiest": ["ka"], "titel": ["kt"]}.get(field, ["ka", "kt", "samen"])
    found = written(found.withColumn("samen", F.concat_ws(" ", "ka", "kt")), "kandidaten")
    term_ = F.lit(asked_for)
    # each text once, and only those whose length allows the likeness
    texts = found.select(F.explode(F.array(*names)).alias("x")).distinct().where("x <> ''")
    inside = F.contains("x", term_)
    short = F.least(F.length("x"), F.length(term_)) * 2 + F.lit(1e-9) >= (F.length("x") + F.length(term_)) * F.lit(least)
    near = texts.where(~inside & short).withColumn("r", likeness(F.col("x"), term_, least)).where(F.col("r") >= least)
    scored = texts.where(inside).select("x", F.lit(1.0).alias("r")).unionByName(near)
    met = found.select("sleutel", "artiest", "titel", F.explode(F.array(*names)).alias("x")).join(scored, "x").select("sleutel", "artiest", "titel", "r")
    asked = list(dict.fromkeys(w for w in asked_for.split(" ") if w))
    if len(asked_for.split()) > 1:
        own = {"artiest": "ka", "titel": "kt"}.get(field, "samen")
        each = found.select("sleutel", "artiest", "titel", F.explode(F.array_distinct(F.split(own, " "))).alias("w")).where("w <> ''")
        marks = each.select("w").distinct().withColumn("q", F.explode(F.array(*map(F.lit, asked))))
        whole = (F.col("w") == F.col("q")) | ((F.length("q") >= 4) & F.contains("w", F.col("q")))
        fits = F.least(F.length("w"), F.length("q")) * 2 + F.lit(1e-9) >= (F.length("w") + F.length("q")) * F.lit(word)
        alike = marks.where(~whole & fits).withColumn("r", likeness(F.col("w"), F.col("q"), word)).where(F.col("r") >= word)
        marks = marks.where(whole).withColumn("r", F.lit(1.0)).unionByName(alike)
        best = each.join(marks, "w").groupBy("sleutel", "artiest", "titel", "q").agg(F.max("r").alias("r"))
        weakest = best.groupBy("sleutel", "artiest", "titel").agg(F.count("*").alias("n"), F.min("r").alias("r")).where(F.col("n") == len(asked))
        met = met.unionByName(weakest.select("sleutel", "artiest", "titel", (F.col("r") * 0.95).alias("r")))
    score = met.groupBy("sleutel", "artiest", "titel").agg(text.rounded(F.max("r"), 3).alias("score"))
    return score.orderBy(F.desc("score"), "sleutel", "artiest", "titel").limit(top)


def alias_closure(aliases: DataFrame) -> DataFrame:
    """aliases(van, naar), each van once -> (van, eind): chains followed to their end, whatever their length. A walk that comes
    round ends at the smallest name on it.

    Pointers double each round; the smallest name passed goes along. A chain of n links takes log2(n) rounds.
    """
    own = aliases.select("van", F.col("naar").alias("eind")).where("van is not null and naar is not null")
    ends = own.select(F.col("eind").alias("van")).distinct().join(own.select("van"), "van", "left_anti").select("van", F.col("van").alias("eind"))
    now = written(own.withColumn("minst", F.least("van", "eind")).unionByName(ends.withColumn("minst", F.col("van"))), "ketens")
    last = ends.select(F.col("van").alias("eind"))
    n, reach = now.count(), 1
    while reach <= n and not now.join(last, "eind", "left_anti").isEmpty():
        on = now.select(F.col("van").alias("eind"), F.col("eind").alias("verder"), F.col("minst").alias("m"))
        now = written(now.join(on, "eind").select("van", F.col("verder").alias("eind"), F.least("minst", "m").alias("minst")), "ketens")
        reach *= 2
    settled = now.join(last.withColumn("einde", F.lit(True)), "eind", "left")
    return settled.select("van", F.when(F.col("einde"), F.col("eind")).otherwise(F.col("minst")).alias("eind")).join(own.select("van"), "van", "left_semi")


def redirects(moves: DataFrame, keys: DataFrame, hops: int = 10) -> DataFrame:
    """moves(oud, nieuw), keys(sleutel) -> (sleutel, doel): where a key has moved to after at most `hops` moves; null if it never
    moved. A walk that comes round stops before it repeats."""
    step = moves.select(F.col("oud").alias("doel"), F.col("nieuw").alias("verder"))
    now = keys.select("sleutel", F.col("sleutel").alias("doel"), F.array("sleutel").alias("pad"))
    for _ in range(hops):
        on = now.join(step, "doel", "left")
        go = F.col("verder").isNotNull() & ~F.array_contains("pad", F.col("verder"))
        now = on.select("sleutel", F.when(go, F.col("verder")).otherwise(F.col("doel")).alias("doel"), F.when(go, F.array_append("pad", "verder")).otherwise(F.col("pad")).alias("pad"))
    return now.select("sleutel", F.when(F.size("pad") > 1, F.col("doel")).alias("doel"))


def award_links(awards: DataFrame, songs: DataFrame, least: float = 0.6, whole: float = 0.85) -> DataFrame:
    """awards(id, jaar, naam), songs(sleutel, jaar, artiest, titel) -> (id, sleutel, score): of the songs of that year and the
    next the one with the best score, the smallest key on ties. The score is 0.7 * title + 0.3 * artist containment; for a song
    under `least` by words it is the likeness of all words in order, put together, from `whole` on, so that names written apart
    or as one still meet."""
    a = awards.select("id", F.explode(F.array("jaar", F.col("jaar") + 1)).alias("jaar"), text.linking_words(F.col("naam")).alias("w"))
    t = songs.select("sleutel", "jaar", text.linking_words(F.col("titel")).alias("t"), text.core_words(F.col("titel")).alias("k"), text.linking_words(F.col("artiest")).alias("ar")).distinct()
    index = t.select("sleutel", "jaar", F.explode(F.array_union("t", "ar")).alias("woord"))
    near = a.withColumn("woord", F.explode("w")).join(index, ["jaar", "woord"]).select("id", "jaar", "w", "sleutel").distinct().join(t, ["sleutel", "jaar"])
    score = 0.7 * F.greatest(text.contained(F.col("t"), F.col("w")), text.contained(F.col("k"), F.col("w"))) + 0.3 * text.contained(F.col("ar"), F.col("w"))
    best = near.withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    flat = lambda *c: text.sorted_words(F.concat_ws(" ", *c))
    asked = awards.select("id", F.explode(F.array("jaar", F.col("jaar") + 1)).alias("jaar"), flat("naam").alias("p")).where("p <> ''")
    had = songs.select("sleutel", "jaar", flat("titel", "artiest").alias("q")).where("q <> ''").distinct()
    names = asked.select("jaar", F.col("p").alias("naam")).unionByName(had.select("jaar", F.col("q").alias("naam")))
    pairs = near_pairs(names, ["jaar"], whole, 1_000_000)
    either = pairs.select("jaar", F.col("a").alias("p"), F.col("b").alias("q")).unionByName(pairs.select("jaar", F.col("b").alias("p"), F.col("a").alias("q")))
    either = either.unionByName(asked.select("jaar", "p", F.col("p").alias("q")).distinct())
    met = asked.join(either, ["jaar", "p"]).join(had, ["jaar", "q"]).select("id", "sleutel", "p", "q").join(best.select("id", "sleutel"), ["id", "sleutel"], "left_anti")
    alike = met.withColumn("score", likeness(F.col("q"), F.col("p"), whole)).where(F.col("score") >= whole)
    best = best.select("id", "sleutel", "score").unionByName(alike.select("id", "sleutel", F.round("score", 6).alias("score")))
    return best.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("m"), "sleutel")).alias("b")).select("id", "b.sleutel", (-F.col("b.m")).alias("score"))


def awards_per_key(awards: DataFrame, year: int) -> DataFrame:
    """awards(sleutel, jaar, soort, datum) of a year and the year before: the last date of each kind for each key."""
    rows = awards.where(F.col("jaar").isin(year, year - 1) & F.col("sleutel").isNotNull())
    return rows.groupBy("sleutel", "soort").agg(F.max("datum").alias("datum"))


def reconcile(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """ours, theirs(sleutel, punten, weken, hoogste) -> (sleutel, soort): gelijk, klein, groot (weeks differ by more than 2, or
    points by more than max(2, 5 %)), alleen_zij, alleen_wij."""
    of = lambda d, n: d.select("sleutel", *[F.col(c).alias(f"{n}_{c}") for c in ("punten", "weken", "hoogste")])
    both = of(ours, "o").join(of(theirs, "z"), "sleutel", "full")
    dp, dw = F.abs(F.col("o_punten") - F.col("z_punten")), F.abs(F.col("o_weken") - F.col("z_weken"))
    same = (dp == 0) & (dw == 0) & (F.col("o_hoogste") == F.col("z_hoogste"))
    large = (dw > 2) | (dp > F.greatest(F.lit(2.0), F.bround(F.col("z_punten") * 0.05)))
    kind = F.when(F.col("o_punten").isNull(), "alleen_zij").when(F.col("z_punten").isNull(), "alleen_wij").when(same, "gelijk").when(large, "groot").otherwise("klein")
    return both.select("sleutel", kind.alias("soort"))
