"""Deliveries in any order, snapshots that store what changed, ranks over many partitions."""

import random

import pytest
from podium.operators.ordering import in_parts, ranked
from podium.sources import snapshots
from podium.sources.entries import ENTRY_SCHEMA, read_entries
from podium.streaming import ingest as ing
from pyspark.sql import functions as F


def delivery(lijst, jaar, week, levering, songs, page=None):
    pj, pw = page or (jaar, week)
    return [(lijst, jaar, week, p, f"T{s}", f"A{s}", f"a{s}|t{s}", pj, pw, levering) for p, s in songs]


DELIVERIES = [
    delivery("wk", 2020, 1, 1, [(1, 1), (2, 2)]) + delivery("wk", 2020, 2, 1, [(1, 2), (2, 1)]),
    delivery("wk", 2020, 2, 2, [(1, 3), (2, 1)]) + delivery("wk", 2021, 1, 2, [(1, 1), (2, 9)]),
    delivery("wk", 2020, 1, 3, [(1, 7)], page=(2020, 2)) + delivery("wk", 2020, 3, 3, [(1, 1), (9, 2)]) + delivery("x", 2020, 1, 3, [(1, 1), (1, 1), (2, 2)]),
    delivery("wk", 2020, 2, 4, [(1, 4), (1, 5), (2, 1)]),
]
WANT = {("wk", 2020, 1, 1, "a1|t1"), ("wk", 2020, 1, 2, "a2|t2"), ("wk", 2021, 1, 1, "a1|t1"), ("wk", 2021, 1, 2, "a9|t9")} | {("wk", 2020, 2, 1, "a4|t4"), ("wk", 2020, 2, 1, "a5|t5"), ("wk", 2020, 2, 2, "a1|t1")}


def stored(spark, path):
    return {(r.lijst, r.jaar, r.week, r.positie, r.sleutel) for r in read_entries(spark, path).collect()}


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0]])
def test_deliveries_in_any_order_twice_give_one_table(spark, tmp_path, order):
    place = {n: str(tmp_path / n) for n in ("landing", "entries", "ledger", "rejected", "checkpoint")}
    for again in range(2):
        for k in order:
            rows = spark.createDataFrame(DELIVERIES[k], ing.DELIVERY)
            # a song twice on a place, unlike its spelling: a repeated row alone is no fault
            rows = rows.withColumn("titel", F.when((F.col("lijst") == "x") & (F.rand(k) < 0.5), F.upper("titel")).otherwise(F.col("titel")))
            rows.coalesce(1).write.mode("append").parquet(place["landing"])
            ing.ingest(spark, place["landing"], place["entries"], place["ledger"], place["rejected"], place["checkpoint"], 1).awaitTermination()
    assert {x for x in stored(spark, place["entries"]) if x[0] == "wk"} == WANT
    ledger = {(r.lijst, r.jaar, r.week): (r.levering, r.aantal) for r in ing.read_ledger(spark, place["ledger"]).where("lijst = 'wk'").collect()}
    assert ledger == {("wk", 2020, 1): (1, 2), ("wk", 2020, 2): (4, 3), ("wk", 2021, 1): (2, 2)}
    bad = {(r.lijst, r.week, r.levering, r.fout) for r in spark.read.parquet(place["rejected"]).collect()}
    assert {("wk", 1, 3, "andere week"), ("wk", 3, 3, "posities")} <= bad
    published = ing.last_published(spark.read.schema(ing.DELIVERY).parquet(place["landing"])).where("lijst = 'wk'")
    assert [(r.jaar, r.week) for r in published.collect()] == [(2021, 1)]
    absent = spark.createDataFrame([("wk", 2020, w) for w in range(4, 53)], "lijst string, jaar int, week int")
    assert {(r.jaar, r.week) for r in ing.still_to_fetch(ing.read_ledger(spark, place["ledger"]), absent, published).collect()} == {(2020, 3), (2020, 53)}


def test_faults(spark):
    rows = delivery("a", 2020, 1, 1, [(1, 1), (2, 2), (5, 3)]) + delivery("b", 2020, 1, 1, [(1, 1), (5, 2)]) + delivery("c", 2020, 1, 1, [(1, 1), (1, 1)]) + delivery("d", 2020, 1, 1, [(None, 1)]) + delivery("e", 2020, 1, 1, [(1, 1), (1, 2)], (None, 1))
    got = {r.lijst: r.fout for r in ing.delivery_faults(spark.createDataFrame(rows, ing.DELIVERY)).collect()}
    assert got == {"a": None, "b": "posities", "c": "dubbel", "d": "posities", "e": "andere week"}


def test_snapshots_store_what_changed_and_restore(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [("t", y, 1, p, "T", "A", f"k{y}{p}|x") for y in (2020, 2021) for p in (1, 2)]
    first = spark.createDataFrame(rows, ENTRY_SCHEMA)
    second = first.withColumn("sleutel", F.when(F.col("jaar") == 2021, F.lit("new|x")).otherwise(F.col("sleutel")))
    for again in range(2):
        snapshots.take_snapshot(first, store, "a", "2024-01-01 10:00:00")
    snapshots.take_snapshot(second.repartition(3), store, "b", "2024-01-02 10:00:00")
    stored_rows = lambda: {(r.jaar, r.n) for r in spark.read.parquet(f"{store}/rows").groupBy("jaar", "vinger").agg(F.count("*").alias("n")).collect()}
    assert sorted(spark.read.parquet(f"{store}/rows").groupBy("jaar").count().collect()) == [(2020, 2), (2021, 4)]
    assert snapshots.manifests(spark, store).count() == 4
    of = lambda name: sorted(map(tuple, snapshots.restore(spark, store, name, ENTRY_SCHEMA).collect()))
    assert of("a") == sorted(map(tuple, first.collect())) and of("b") == sorted(map(tuple, second.collect()))
    assert snapshots.drop_old(spark, store, "2024-01-02", newest=1, days=1) == ["a"]
    assert stored_rows() == {(2020, 2), (2021, 2)} and of("b") == sorted(map(tuple, second.collect()))
    with pytest.raises(ValueError):
        of("a")
    with pytest.raises(ValueError):
        snapshots.take_snapshot(first.limit(0), store, "c", "2024-01-03 10:00:00")


def test_what_stays(spark):
    times = [(f"s{d:02d}{h:02d}", f"2024-03-{d:02d} {h:02d}:00:00") for d in range(1, 29) for h in (8, 12)]
    s = spark.createDataFrame(times, "naam string, t string").selectExpr("naam", "to_timestamp(t) tijd")
    got = {r.naam for r in snapshots.to_keep(s, "2024-03-28", 3, 10).collect()}
    assert got == {"s2812", "s2808", "s2712"} | {f"s{d:02d}08" for d in range(19, 29)}


def test_ranks_and_parts(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaab"), rng.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, g string, v int").repartition(5)
    got = {r.i: r.plek for r in ranked(df, [F.desc("g"), F.col("v"), F.col("i")]).collect()}
    want = sorted(rows, key=lambda r: (-ord(r[1]), r[2], r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 301))
    parts = [r["count"] for r in in_parts(df, [F.col("i")], 70).groupBy("deel").count().orderBy("deel").collect()]
    assert parts == [70, 70, 70, 70, 20] and ranked(df.limit(0), [F.col("i")]).count() == 0
