"""Queries of ingest, snapshots and parts, over deliveries made from the archive, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.ordering import in_parts
from podium.sources import snapshots
from podium.sources.entries import ENTRIES_SQL, ENTRY_SCHEMA, archive, read_entries
from podium.sources.storage import shared_dir
from podium.streaming import ingest as ing


def _sql(body: str) -> str:
    return f"with recursive {ENTRIES_SQL.strip()} {body}"


def _delivered(spark: SparkSession, sf: str) -> dict[str, str]:
    """Three deliveries of the archive, the latest first: corrected even weeks; all weeks with titles in capitals; weeks divisible by
    5 once more, but from pages of another week."""
    root = f"{shared_dir(spark)}/inname-{uuid.uuid4().hex}"
    place = {n: f"{root}/{n}" for n in ("landing", "entries", "ledger", "rejected", "checkpoint")}
    e = archive(spark, sf).withColumns({"pagina_jaar": F.col("jaar"), "pagina_week": F.col("week")})
    shouted = e.withColumn("titel", F.upper("titel"))
    for number, rows in ((2, e.where("week % 2 = 0")), (1, shouted), (3, shouted.where("week % 5 = 0").withColumn("pagina_week", F.col("week") + 1))):
        rows.withColumn("levering", F.lit(number).cast("long")).select(*[f.name for f in ing.DELIVERY.fields]).write.mode("append").parquet(place["landing"])
    ing.ingest(spark, place["landing"], place["entries"], place["ledger"], place["rejected"], place["checkpoint"], 1).awaitTermination()
    return place


def _ingested(spark: SparkSession, sf: str) -> DataFrame:
    return read_entries(spark, _delivered(spark, sf)["entries"])


def _to_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """What a source that has just published its last week has besides a ledger without every sixth week; every tenth week never
    was."""
    e = archive(spark, sf).where("lijst like 'wk@_%' escape '@'")
    ledger = e.where("week % 6 <> 5 and not (jaar = 1997 and week > 40)").groupBy("lijst", "jaar", "week").agg(F.count("*").alias("aantal"))
    absent = e.where("week % 10 = 5").select("lijst", "jaar", "week").distinct()
    published = ing.last_published(e.select("lijst", F.col("jaar").alias("pagina_jaar"), F.col("week").alias("pagina_week")))
    return ing.still_to_fetch(ledger, absent, published)


def _restored(spark: SparkSession, sf: str) -> DataFrame:
    """The archive as it was before every title of a year was lost."""
    store = f"{shared_dir(spark)}/momenten-{uuid.uuid4().hex}"
    e = archive(spark, sf)
    snapshots.take_snapshot(e, store, "voor", "2024-01-01 10:00:00")
    snapshots.take_snapshot(e.withColumn("titel", F.when(F.col("jaar") == 1997, F.lit("?")).otherwise(F.col("titel"))), store, "na", "2024-01-02 10:00:00")
    return snapshots.restore(spark, store, "voor", ENTRY_SCHEMA)


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Songs in the order of their keys, in files of at most 1,000."""
    return in_parts(archive(spark, sf).groupBy("sleutel").agg(F.max("jaar").alias("jaar")), [F.col("sleutel")], 1000)


QUERIES = {
    "ingested_entries": (_ingested, _sql("select lijst, jaar, week, positie, case when week % 2 = 0 then titel else upper(titel) end titel, artiest, sleutel from e")),
    "still_to_fetch": (
        _to_fetch,
        _sql(
            ", w as (select distinct lijst, jaar, week from e where lijst like 'wk@_%' escape '@'), p as (select lijst, max((jaar, week)) x from w group by lijst), k as (select * from w where week % 6 <> 5 and not (jaar = 1997 and week > 40)), h as (select * from k union select * from w where week % 10 = 5), "
            "q as (select lijst, x[1] jaar, cast(unnest(range(1, x[2] + 1)) as integer) as week from p union all select k.lijst, k.jaar, cast(unnest(range(max(week) + 1, 54)) as integer) from k join p on p.lijst = k.lijst and k.jaar = x[1] - 1 group by k.lijst, k.jaar) select * from q anti join h using (lijst, jaar, week)"
        ),
    ),
    "restored_snapshot": (_restored, _sql("select lijst, jaar, week, positie, titel, artiest, sleutel from e")),
    "key_parts": (_parts, _sql(", k as (select sleutel, max(jaar) jaar, cast(row_number() over (order by sleutel) as integer) plek from e group by sleutel) select *, cast(floor((plek - 1) / 1000) + 1 as integer) deel from k")),
}
