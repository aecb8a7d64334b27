"""URL filters: fixed host and path rules, else association rules that Spark's FP-growth mines from labelled urls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import materialize

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_BAD = "@block"


@dataclass(frozen=True)
class Mining:
    """min_support: share of labelled pages that are unwanted and have the rule's tokens, at least (and min_count pages).

    Confidence is the share of the pages with the tokens that are unwanted. It must be min_lift times the share of unwanted
    ones among all labelled pages, and lie above that share even at the lower end of its interval at z standard errors (Wilson).
    """

    min_support: float = 0.001
    min_count: int = 20
    min_lift: float = 1.2
    z: float = 1.645


def host_path(url: Column) -> tuple[Column, Column]:
    """host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end; else empty."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """The distinct tokens of a url: host labels, path words without digits, query keys, each with its kind."""
    query = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#?]+)"), F.lit(1))
    words = F.filter(F.split(path, r"[^A-Za-z]+"), lambda x: x != "")
    parts = F.concat(
        F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("p:"), F.lower(x))),
        F.transform(F.coalesce(query, F.array().cast("array<string>")), lambda x: F.concat(F.lit("q:"), F.lower(x))),
    )
    return F.array_distinct(parts)


def _merged(sets: DataFrame, least: float, n: int) -> DataFrame:
    """sets(tokens, pages, bad) of distinct tokens -> (item, alternatives): the tokens that `least` unwanted pages have, those of
    exactly the same labelled pages as one item. Tokens of all n pages tell nothing and are no item.

    Pages are compared by their number and two sums of 64-bit hashes of their token sets."""
    key = [F.xxhash64(F.lit(seed), "tokens").cast("decimal(38,0)") for seed in (1, 2)]
    each = sets.select(F.explode("tokens").alias("token"), "pages", "bad", *[k.alias(f"k{i}") for i, k in enumerate(key)])
    same = [F.sum(x).alias(x) for x in ("k0", "k1", "pages", "bad")]
    of = each.groupBy("token").agg(*same).where(F.col("bad") >= least)
    items = of.groupBy("k0", "k1", "pages", "bad").agg(F.array_sort(F.collect_list("token")).alias("alternatives"))
    return items.where(F.col("pages") < n).select(F.col("alternatives")[0].alias("item"), "alternatives")


def mine_rules(labelled: DataFrame, mining: Mining | None = None) -> DataFrame:
    """labelled(tokens, bad boolean) -> (antecedent, confidence, support, rarest, fits): rules for unwanted urls.

    Tokens of exactly the same labelled pages are one item, named by the first of them, so urls that repeat as a whole don't
    give each of their token combinations. fits holds for each item of the antecedent its tokens, rarest those of its rarest item:
    a url fits with one of each. These are the same rules as without items, written once.

    FP-growth finds the combinations that enough unwanted pages have; how many of all labelled pages have them comes from the
    inverted index that matches rules too. Of the rules that are sure enough none stays that a rule of fewer items with no
    less confidence makes needless. Empty without labelled or without unwanted pages.
    """
    mining = mining or Mining()
    spark = labelled.sparkSession
    known = labelled.where("bad is not null and tokens is not null").select(F.array_sort("tokens").alias("tokens"), F.col("bad").cast("long").alias("bad"))
    sets = materialize(known.groupBy("tokens").agg(F.count("*").alias("pages"), F.sum("bad").alias("bad")), "sets")
    n, n_bad = sets.agg(F.sum("pages"), F.sum("bad")).first()
    if not n_bad:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, rarest array<string>, fits array<array<string>>")
    share = n_bad / n
    least = max(mining.min_support * n, mining.min_count)
    items = materialize(_merged(sets, least, n), "items")
    of = items.select("item", F.explode("alternatives").alias("token"))
    each = sets.withColumn("key", F.col("tokens")).select("key", "pages", "bad", F.explode("tokens").alias("token")).join(of, "token")
    sets = each.groupBy("key", "pages", "bad").agg(F.array_sort(F.collect_set("item")).alias("tokens"))
    sets = materialize(sets.groupBy("tokens").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad")), "sets")
    # equal sets come from one row, by thousands
    rows = sets.where("bad > 0").select("tokens", "bad", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bad") - 1, F.lit(1000).cast("long"))).alias("at"))
    rows = rows.select("tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000).cast("long"), F.col("bad") - F.col("at"))))).select("tokens")
    n_rows = sets.agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0]  # unwanted pages that have an item
    found = FPGrowth(itemsCol="tokens", minSupport=min(1.0, least / max(1, n_rows))).fit(rows).freqItemsets
    found = materialize(found.where(F.col("freq") >= least), "itemsets")
    single = found.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), F.col("freq").alias("one"))
    each = found.select(F.array_sort("items").alias("antecedent"), "freq", F.explode("items").alias("item")).join(single, "item")
    keyed = materialize(each.groupBy("antecedent", "freq").agg(F.min_by("item", F.struct("one", "item")).alias("rarest")), "itemsets")
    fits = index_match(sets.select("tokens", "pages"), keyed)
    total = fits.groupBy("antecedent").agg(F.sum("pages").cast("double").alias("total"))
    p, z2 = F.col("freq") / F.col("total"), mining.z**2
    lower = (p + z2 / (2 * F.col("total")) - mining.z * F.sqrt(p * (1 - p) / F.col("total") + z2 / (4 * F.col("total") ** 2))) / (1 + z2 / F.col("total"))
    rules = keyed.join(total, "antecedent").where((p >= mining.min_lift * share) & (lower > share))
    rules = materialize(rules.select("antecedent", p.alias("confidence"), (F.col("freq") / n).alias("support"), "rarest"), "rules")
    # shorter rules are found by an item that both have: the shorter one's rarest
    wide = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item"))
    short = rules.select(F.col("antecedent").alias("less"), F.col("confidence").alias("sure"), F.col("rarest").alias("item"))
    needless = wide.join(short, "item").where(
        (F.size("less") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "antecedent")) == 0)
    )
    rules = rules.join(needless.select("antecedent").distinct(), "antecedent", "left_anti")
    each = rules.select("*", F.explode("antecedent").alias("item")).join(items, "item")
    rare = F.max(F.when(F.col("item") == F.col("rarest"), F.col("alternatives"))).alias("rarest")
    return each.groupBy("antecedent", "confidence", "support").agg(rare, F.collect_list("alternatives").alias("fits"))


def index_match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows(tokens, ...) joined with the rules(antecedent, rarest, ...) that they fit, by an inverted index on the rules'
    rarest tokens."""
    met = rows.withColumn("rarest", F.explode("tokens")).join(rules, "rarest")
    return met.where(F.size(F.array_except("antecedent", "tokens")) == 0)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url, tokens) -> (url, confidence) of those that a rule fits, with that of the surest rule; equal ones don't matter."""
    posts = rules.select(F.explode("rarest").alias("token"), "fits", "confidence")
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(posts, "token")
    fits = met.where(F.forall("fits", lambda x: F.arrays_overlap(x, F.col("tokens"))))
    return fits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, mining: Mining | None = None
) -> DataFrame:
    """pages(page_id, url), labels(doc_id, quality, toxic) -> (page_id, host, path, rule, verdict, confidence).

    A fixed rule fits its host and all subdomains if the path starts with the rule's; the longest one decides. Else a mined
    rule blocks; else the url is allowed. A page is labelled by the row of labels with its id; it is unwanted if its quality is
    0 or toxic is 1 (null: not known to be); rows without both are not learnt from. Null urls and those without :// have an
    empty host and path and no tokens but the query's. A row for each row of pages; other columns are ignored, whatever their
    names; an empty table gives no rows. Verdicts depend on the url alone, so repeated rows agree.
    """
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = base.select("url", "host", "path").where("url is not null").distinct().withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    bad = F.when(F.coalesce("quality", "toxic").isNotNull(), F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = base.join(known, "page_id").select(tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), "bad")
    hits = match_rules(urls, mine_rules(labelled, mining))
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule: Column = F.lit(None).cast("string")
    fixed: Column = F.lit(None).cast("string")
    for h, p, verdict in reversed(ordered):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, fixed = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(fixed)
    out = base.join(hits, "url", "left").withColumn("rule", rule)
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(fixed, mined).alias("verdict"), "confidence")
