"""Text rules for artists and titles: cleaning, canonical keys, credits, word sets.

Rules are column expressions. Null stays null, an empty text stays empty; other cases are told at each rule.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Typographic characters and what they become in keys.
TYPOGRAPHY = (("‘", "'"), ("’", "'"), ("‚", "'"), ("“", '"'), ("”", '"'), ("„", '"'), ("–", "-"), ("—", "-"), ("−", "-"), (" ", " "), ("​", ""))
#: What texts are cleaned of besides.
CLEANED = (("`", "'"), ("´", "'"), *TYPOGRAPHY, ("‐", "-"), ("‑", "-"), ("�", ""))
#: Letters without a decomposition.
LETTERS = (("ø", "o"), ("Ø", "O"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ß", "ss"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("ð", "d"), ("Ð", "D"), ("þ", "th"), ("Þ", "TH"), ("ı", "i"), ("ħ", "h"), ("ŧ", "t"), ("ĸ", "k"))
#: Names in which x, a comma or "met" is no separator.
X_NAMES = ("dutch x factor", "x factor")
COMMA_NAMES = (
    "Ashton, Gardner & Dyke", "Blood, Sweat & Tears", "Cotton, Lloyd & Christian", "Crosby, Stills & Nash", "Crosby, Stills, Nash & Young",
    "Dave Dee, Dozy, Beaky, Mick & Tich", "Dutch, Rhythm, Steel & Show Band", "Earth, Wind & Fire", "Ecstasy, Passion & Pain", "Emerson, Lake & Palmer",
    "Faith, Hope & Charity", "Grover Washington, Jr.", "Hamilton, Joe Frank & Reynolds", "Julie Driscoll, Brian Auger & The Trinity", "Linda, Roos & Jessica",
    "Lipps, Inc.", "Los Angeles, The Voices", "Marilyn McCoo & Billy Davis, Jr.", "Marshall, Hain", "Marvin, Welch & Farrar", "McGuinn, Clark & Hillman",
    "Peter, Paul and Mary", "Portugal, The Man", "Ray, Goodman & Brown", "Tina, Toos & Tessa", "Tyler, The Creator",
)
MET_NAMES = ("zondag met lubach", "fokko met de bordjes")
#: Words that tell a subtitle, as a pattern.
SUBTITLE = r"(?i)\b(?:re-?mix(?:es)?|rmx|mix(?:es)?|live|version|versie|edit|akoestisch|acoustic|unplugged|instrumenta[al]*|demo|club|extended|radio|mono|stereo|deel [ivx0-9]+|part [ivx0-9]+|pt\.? [ivx0-9]+|theme|thema|titelsong|titeltrack|tune|anthem|tribute|g[eé]n[eé]rique|soundtrack|titelnummer)\b"
#: Words that don't tell acts apart.
SMALL_WORDS = ("the", "de", "het", "een", "en", "met", "and", "with", "&", "ft", "feat", "van", "der", "los", "las", "les")


def _mapped(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s{2,}", " "))


def clean_text(c: Column) -> Column:
    """Plain quotes and dashes, no replacement characters, single spaces, single parentheses."""
    return _spaced(F.regexp_replace(_mapped(c, CLEANED), r"\(\((.+?)\)\)", "($1)"))


def unify_credit(c: Column) -> Column:
    """featuring, feat., ft. and w/ become &."""
    return _spaced(F.regexp_replace(c, r"(?i)\s*\b(?:featuring|feat\b\.?|ft\b\.?|w/)\s*", " & "))


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())


def fold(c: Column) -> Column:
    """Lower case without combining marks (NFKD). Spark has no built-in for it; call it on distinct strings."""
    return _folded(c)


def bare(c: Column) -> Column:
    """Without accents, capitals and blanks at the ends; letters without a decomposition too."""
    return F.trim(fold(_mapped(c, LETTERS)))


def _has_name(c: Column, names: tuple[str, ...]) -> Column:
    return F.regexp_like(bare(c), F.lit("|".join(re.escape(n.lower()) for n in names)))


def guest_from_title(artist: Column, title: Column) -> tuple[Column, Column]:
    """(artist, title): a guest in parentheses in the title goes to the artist, unless it stands there already."""
    pattern = r"\s*\((?:feat|ft|featuring)\b\.?\s*([^)]+)\)"
    guest = F.trim(F.regexp_extract(title, pattern, 1))
    found = F.regexp_like(title, F.lit(pattern))
    with_guest = F.btrim(F.concat_ws(" & ", artist, guest), F.lit(" &"))
    known = F.contains(bare(F.coalesce(artist, F.lit(""))), bare(guest))
    return F.when(found & ~known, with_guest).otherwise(artist), F.when(found, _spaced(F.regexp_replace(title, pattern, ""))).otherwise(title)


def x_joins(c: Column) -> Column:
    """A lone x between two names becomes &, but not next to a separator and not in protected names."""
    return F.when(_has_name(c, X_NAMES), c).otherwise(_spaced(F.regexp_replace(c, r"(?i)(?<=[^&,/+(])\s+x\s+(?=[^&,/+)])", " & ")))


def comma_joins(c: Column) -> Column:
    """A comma between names becomes &, but not in protected names."""
    keep = ~F.contains(c, F.lit(",")) | _has_name(c, COMMA_NAMES)
    return F.when(keep, c).otherwise(F.trim(F.replace(F.regexp_replace(F.replace(c, F.lit(","), F.lit(" & ")), r"\s{2,}", " "), F.lit(" & & "), F.lit(" & "))))


def met_joins(c: Column) -> Column:
    """The Dutch "met" between names becomes &; "(in) duet met" and "samen met" go as a whole, phrases of thanks stay."""
    phrase = F.regexp_like(c, F.lit(r"(?i)\bmet\s+(?:dank\s+aan|medewerking\s+van|zang\s+van|begeleiding\s+van)"))
    joined = F.regexp_replace(F.regexp_replace(c, r"(?i)\s*(?:-\s*)?\b(?:in\s+)?duet\s+met\s+|\s+samen\s+met\s+", " & "), r"(?i)\s+met\s+", " & ")
    return F.when(_has_name(c, MET_NAMES) | phrase, c).otherwise(_spaced(joined))


def subtitle_in_parentheses(c: Column) -> Column:
    """"Title - Sub" becomes "Title (Sub)" where the second part has a word of versions or themes."""
    head = F.substring_index(c, " - ", 1)
    tail = F.regexp_extract(c, r"(?s)^.*? - (.*)$", 1)
    many = lambda ch: F.length(head) - F.length(F.replace(head, F.lit(ch), F.lit("")))
    fits = F.contains(c, F.lit(" - ")) & (many("(") == many(")")) & (F.trim(head) != "") & F.regexp_like(tail, F.lit(SUBTITLE))
    flat = F.trim(F.replace(tail, F.lit(" - "), F.lit(" ")))
    flat = F.regexp_replace(flat, r"(?s)^\((.*)\)$", "$1")
    return F.when(fits, F.concat(F.trim(head), F.lit(" ("), flat, F.lit(")"))).otherwise(c)


def without_source_noise(c: Column) -> Column:
    """Without " / ..." at the end and without double parentheses."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\(\(.*?\)\)", " "), r"\s+/\s+.*$", ""))


def without_release(c: Column) -> Column:
    """"Release : Song" becomes "Song"."""
    return F.regexp_replace(c, r"^.+? : (?=.)", "")


def normalise(c: Column, artist: bool = False) -> Column:
    """A text of [a-z0-9 &] alone; in an artist all words and signs between names become &, in a title only & and "and"."""
    c = _mapped(_mapped(c, TYPOGRAPHY), LETTERS)
    c = F.regexp_replace(F.regexp_replace(c, r"['`‘’ʼ]", ""), r"\.(?!\s)", "")
    c = fold(c)
    if artist:
        c = F.regexp_replace(c, r"\s*(?:\bfeat\b\.?|\bft\b\.?|\bfeaturing\b|\bwith\b|\bw/|\bmet\b)(?=\s*\S)\s*", " & ")
        c = F.regexp_replace(c, r"\s*(?:&|\+|(?:(?:\band\b|\bx\b|\bvs\b\.?|\bversus\b)(?=\s*\S)))\s*", " & ")
    else:
        c = F.regexp_replace(c, r"\s*(?:&|\band\b)\s*", " & ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9 &]", " "), r"\s+", " "))


def key_part(c: Column, artist: bool = False) -> Column:
    """The canonical form of an artist or a title."""
    return F.regexp_replace(normalise(c, True), r"^(?:the|de|het) ", "") if artist else normalise(c)


def song_key(artist: Column, title: Column) -> Column:
    return F.concat(key_part(artist, True), F.lit("|"), key_part(title))


def rekeyed(key: Column) -> Column:
    """A key normalised again, part by part; without a pipe it stays as it is."""
    both = song_key(F.substring_index(key, "|", 1), F.regexp_extract(key, r"(?s)^[^|]*\|(.*)$", 1))
    return F.when(F.contains(key, F.lit("|")), both).otherwise(key)


def words(c: Column, least: int = 3) -> Column:
    """The distinct words of at least `least` letters."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) >= least))


def act_words(c: Column) -> Column:
    """The words of an artist that tell acts apart."""
    return F.array_except(F.filter(F.split(normalise(c, True), " "), lambda w: w != ""), F.array(*map(F.lit, SMALL_WORDS)))


def same_act(a: Column, b: Column) -> Column:
    """Whether two artists share a word that tells acts apart."""
    return F.arrays_overlap(act_words(a), act_words(b))


def linking_words(c: Column) -> Column:
    """The distinct words of a name for linking; & counts as a blank."""
    return F.array_distinct(_word_list(c))


def _word_list(c: Column) -> Column:
    return F.filter(F.split(normalise(F.replace(c, F.lit("&"), F.lit(" "))), " "), lambda w: (w != "") & (w != "&"))


def core_words(c: Column) -> Column:
    """linking_words of a title without what stands in round or square brackets and without what follows a dash; of the whole if
    nothing is left."""
    core = linking_words(F.substring_index(F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", " "), " - ", 1))
    return F.when(F.size(core) > 0, core).otherwise(linking_words(c))


def sorted_words(c: Column) -> Column:
    """All words in order, repeats too, put together without blanks."""
    return F.array_join(F.array_sort(_word_list(c)), "")


def title_case(c: Column) -> Column:
    """The first letter of each word in capitals; what is capital already stays, letters after an apostrophe stay small."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def split_sides(artist: Column, title: Column, separator: str) -> Column:
    """An array of (artiest, titel): the parts of both by the separator, or each title with the whole artist if their numbers
    differ."""
    a = F.transform(F.split(artist, F.lit(separator)), lambda x: F.trim(x))
    t = F.transform(F.split(title, F.lit(separator)), lambda x: F.trim(x))
    equal = F.size(a) == F.size(t)
    return F.transform(t, lambda x, i: F.struct(F.when(equal, F.get(a, i)).otherwise(artist).alias("artiest"), x.alias("titel")))


def years_and_weeks(weeks: Column) -> Column:
    """52 weeks make a year; fewer than 4 weeks besides aren't told: "40 weken", "1 jaar", "2 jaar en 7 weken"."""
    y, w = F.floor(weeks / 52).cast("string"), weeks % 52
    year = F.concat(y, F.lit(" jaar"))
    return F.when(weeks < 52, F.concat(weeks.cast("string"), F.lit(" weken"))).when(w < 4, year).otherwise(F.concat(year, F.lit(" en "), w.cast("string"), F.lit(" weken")))


def local_number(value: Column, decimals: int = 1) -> Column:
    """A number with a decimal comma and points between thousands."""
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def contained(a: Column, b: Column) -> Column:
    """The share of a that b has; 0 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def rounded(value: Column, digits: int) -> Column:
    """A value from 0 to 1 rounded by its exact binary value, ties to even."""
    exact = (value * F.lit(2.0**53)).cast("decimal(20,0)") / F.lit(2**53).cast("decimal(16,0)")
    return F.bround(exact, digits).cast("double")


def subset_either_way(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def split_line(line: Column) -> Column:
    """"artists - titles" of a shared place as an array of (artiest, titel), trimmed: cut at the first " - " that leaves as many
    parts between " / " on both sides, two at least. Null where there is none, and for null."""
    parts = F.split(line, " - ")

    def cut(i: Column) -> Column:
        side = lambda at, n: F.transform(F.split(F.array_join(F.slice(parts, at, n), " - "), " / "), lambda x: F.trim(x))
        return F.struct(side(F.lit(1), i).alias("artiest"), side(i + 1, F.size(parts)).alias("titel"))

    fits = lambda c: (F.size(c["artiest"]) == F.size(c["titel"])) & (F.size(c["titel"]) > 1)
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), cut), fits)
    return F.when(F.size(parts) > 1, F.get(F.transform(cuts, lambda c: F.arrays_zip(c["artiest"].alias("artiest"), c["titel"].alias("titel"))), F.lit(0)))
