"""Connected components of a table of links, as DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b). Minima are pre-aggregated and joined back, so a hub's links stay spread."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    moved = met.where("b > a" if large else "b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = moved if large else moved.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges(a, b) of longs, either way round -> (node, component), component = the smallest node reachable.

    Only nodes with a link to another node are returned; self-links, nulls and repeated links don't matter.
    Each round is written to the shared folder; only two numbers a round reach the driver.
    """
    now = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    for _ in range(max_rounds):
        last, now = now, materialize(_star(_star(now, True), False), "links")
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = seen
    raise RuntimeError("components did not settle")
