"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then a seeded block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.llm.common import WORD, col, hash60, materialize, n_words, ranked

WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """sources(source, source_size) -> with target: weights repeat by code point order of source (null last) and share
    `share` of all sizes; a target stops at limit * source_size and the excess is shared by weight among the others."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = ranked(sources, [F.col("source").asc_nulls_last()], "__rank").withColumn("__w", w).drop("__rank")
    table = materialize(table, "sources")
    cap = F.col("source_size") * F.lit(limit)
    level, stopped = 0.0, -1
    while True:
        over = (F.col("__w") * F.lit(level) > cap) | (F.col("source_size") == 0)
        row = table.agg(
            F.sum("source_size"), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("__w"))), F.sum(over.cast("long"))
        ).first()
        if not row[0] or not row[2] or row[3] == stopped:
            break
        level, stopped = (share * row[0] - row[1]) / row[2], row[3]
    return table.withColumn("target", F.least(cap, F.col("__w") * F.lit(level))).drop("__w")


def quotas(units: DataFrame, block: int) -> DataFrame:
    """units(source, shard, votes double, most long) -> with quota: all blocks go to the units of highest quotients
    votes / (2 * quota + 1), at most `most` each (Sainte-Lague).

    The divisor that hands out nearly all blocks is found by trying 32 at a time in one aggregation; the few blocks
    left go to the highest next quotients.
    """
    total = units.agg(F.sum("votes")).first()[0] or 0.0
    blocks = int(total / block + 0.5)
    at = lambda x: F.least("most", F.floor(F.col("votes") / F.lit(float(x)) + F.lit(0.5)))
    low, high = block / 64.0, block * 4.0
    for _ in range(5):
        tried = [low + (high - low) * k / 32 for k in range(1, 32)]
        sums = list(units.agg(*[F.sum(at(x)) for x in tried]).first())
        fits = [x for x, s in zip(tried, sums, strict=True) if (s or 0) <= blocks]
        above = [x for x, s in zip(tried, sums, strict=True) if (s or 0) > blocks]
        low, high = max(above, default=low), min(fits, default=high)
    first = units.withColumn("quota", at(high).cast("long"))
    left = blocks - (first.agg(F.sum("quota")).first()[0] or 0)
    if left <= 0:
        return first
    quotient = F.col("votes") / (F.col("quota") * 2 + 1)
    more = first.where("quota < most").orderBy(quotient.desc(), F.col("source").asc_nulls_last(), "shard").limit(int(left))
    more = more.select(F.col("source").alias("__s"), F.col("shard").alias("__d"), F.lit(1).alias("__one"))
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__d"))
    return first.join(more, same, "left").withColumn("quota", F.col("quota") + F.coalesce("__one", F.lit(0))).drop("__s", "__d", "__one")


def mix_sizes(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0, block: int | None = None, shard_words: int = 100_000, seed: int = 1
) -> DataFrame:
    """sized(doc_id, source, size, ...) -> its rows with source_size, target, taken and what is taken.

    Each source is dealt into shards of about `shard_words` words by a seeded hash; the words of a shard, documents in
    seeded order, form a ring that is cut into blocks of `block` words (by default a twentieth of the least target above 0,
    from 1 to 64, so that small sources come near theirs too). A shard's quota of consecutive blocks, from a
    seeded place on, is taken; a quota beyond the ring's length goes round again (never more than `limit` times).
    taken = whole * size + head + tail: the document `whole` times, then its first `head` words, then `tail` words from
    its word tail_from (from 0). Sizes of 0 are never taken; null sources are one source; repeated rows are told apart
    by nothing and take their places in the ring one after the other. Reruns agree.
    """
    sized = materialize(sized, "sizes")
    table = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit), "targets")
    least = table.where("target > 0").agg(F.min("target")).first()[0] or 0.0
    block = block or int(max(1, min(64, least / 20)))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words)))
    own = table.withColumnRenamed("source", "__s")
    rows = sized.join(own, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("__h", hash60(F.lit(seed), "doc_id")).withColumn("shard", F.pmod("__h", shards))
    rows = materialize(rows, "dealt")
    units = rows.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").alias("ring")).where("ring > 0")
    units = units.withColumn("votes", F.col("target") * F.col("ring") / F.col("source_size"))
    units = materialize(units.withColumn("most", F.floor(F.col("ring") * F.lit(limit) / F.lit(block))), "units")
    units = quotas(units, block).withColumn("__from", F.pmod(hash60(F.lit(seed), "source", "shard"), "ring"))
    units = units.select(F.col("source").alias("__s"), F.col("shard").alias("__d"), "ring", "quota", "__from")
    rows = rows.join(units, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__d")), "left").drop("__s", "__d")
    order = Window.partitionBy("source", "shard").orderBy("__h", "doc_id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__at", F.pmod(F.coalesce(before, F.lit(0)) - F.col("__from"), "ring"))
    words = F.col("quota") * F.lit(block)
    rows = rows.withColumn("whole", F.coalesce(F.floor(words / F.col("ring")), F.lit(0)))
    rows = rows.withColumn("__rest", F.coalesce(words - F.col("whole") * F.col("ring"), F.lit(0)))
    zero: Column = F.lit(0)
    end = F.col("__at") + F.col("size")
    rows = rows.withColumn("head", F.coalesce(F.greatest(zero, F.least(end, "ring", "__rest") - F.col("__at")), zero))
    rows = rows.withColumn("tail", F.coalesce(F.greatest(zero, F.least(end - F.col("ring"), "__rest")), zero))
    rows = rows.withColumn("tail_from", F.coalesce(F.col("ring") - F.col("__at"), zero))
    rows = rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("head") + F.col("tail"))
    return rows.drop("__h", "__at", "__from", "__rest", "ring", "quota", "shard")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """docs(doc_id, source, text) -> (doc_id, size, source, source_size, target, taken); size counts words, null text: 0."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix_sizes(sized, **how)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def take_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole copy and for each taken part of a document.

    A part's words are joined by one space; a document of which nothing is taken goes, so null, empty and wordless texts go.
    A null source is a source; an empty table stays empty. Columns keep their names, whatever these are.
    """
    row = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*[col(c) for c in docs.columns]).alias("row"))
    taken = mix_sizes(row, **how).where("taken > 0")
    words = F.regexp_extract_all(F.col("row").getField("text"), F.lit(WORD), F.lit(0))
    part = lambda start, n: F.when(n > 0, F.array_join(F.slice(words, (start + 1).cast("int"), n.cast("int")), " "))
    pieces = F.concat(
        F.array_repeat(F.col("row").getField("text"), F.col("whole").cast("int")),
        F.array_compact(F.array(part(F.lit(0), F.col("head")), part(F.col("tail_from"), F.col("tail")))),
    )
    out = taken.select("row", F.explode(pieces).alias("__piece"))
    return out.select(*[F.col("__piece").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
