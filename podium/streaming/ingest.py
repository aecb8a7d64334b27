"""Incremental ingest: deliveries of editions that arrive in a folder become weeks of the entry table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from podium.sources.entries import ENTRY_SCHEMA, replace_weeks, write_entries
from podium.sources.storage import written

#: An entry as delivered: what week the page itself tells, and the number of the delivery, rising with time.
DELIVERY = StructType([*ENTRY_SCHEMA.fields, StructField("pagina_jaar", IntegerType()), StructField("pagina_week", IntegerType()), StructField("levering", LongType())])
LEDGER = "lijst string, jaar int, week int, levering long, aantal long"
_EDITION = ["lijst", "jaar", "week"]


def delivery_faults(rows: DataFrame, holes: int = 2) -> DataFrame:
    """rows of deliveries -> (lijst, jaar, week, levering, aantal, fout): "andere week" if the page tells another week, "posities"
    if one is null or under 1, or more than `holes` of 1..n are missing, "dubbel" if a song stands twice on a place; else null."""
    song = F.struct("positie", F.lower("artiest"), F.lower("titel"))
    each = rows.groupBy(*_EDITION, "levering").agg(
        F.count("*").alias("aantal"),
        F.max(~(F.col("pagina_jaar").eqNullSafe(F.col("jaar")) & F.col("pagina_week").eqNullSafe(F.col("week")))).alias("anders"),
        F.max(F.col("positie").isNull() | (F.col("positie") < 1)).alias("geen"),
        (F.max("positie") - F.count_distinct("positie")).alias("gaten"),
        (F.count("*") - F.count_distinct(song)).alias("dubbel"),
    )
    fault = F.when(F.col("anders"), "andere week").when(F.col("geen") | (F.col("gaten") > holes), "posities").when(F.col("dubbel") > 0, "dubbel")
    return each.select(*_EDITION, "levering", "aantal", fault.alias("fout"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The editions in the table, each with the delivery it comes from. Empty where nothing came yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def ingest_batch(batch: DataFrame, number: int, entries: str, ledger: str, rejected: str) -> None:
    """Takes in one batch. Of an edition's deliveries the latest faultless one stays, whatever order they come in: one that is older than
    the ledger's goes. Whole weeks are replaced, then the ledger; a batch that comes again changes nothing. Faulty deliveries
    are kept in `rejected`, each batch in a folder of its own."""
    spark = batch.sparkSession
    rows = written(batch.distinct(), "levering")
    told = written(delivery_faults(rows), "oordeel")
    bad = told.where("fout is not null")
    rows.join(bad.select(*_EDITION, "levering", "fout"), [*_EDITION, "levering"]).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
    had = read_ledger(spark, ledger)
    last = told.where("fout is null").groupBy(*_EDITION).agg(F.max_by(F.struct("levering", "aantal"), "levering").alias("x")).select(*_EDITION, "x.*")
    older = had.select(*_EDITION, F.col("levering").alias("was"))
    new = written(last.join(older, _EDITION, "left").where("was is null or levering >= was").drop("was"), "nieuw")
    if new.isEmpty():
        return
    weeks = rows.join(new.select(*_EDITION, "levering"), [*_EDITION, "levering"], "left_semi").select(*ENTRY_SCHEMA.names)
    if had.isEmpty():
        write_entries(weeks, entries)
    else:
        replace_weeks(spark, entries, weeks)
    years = had.join(new.select("lijst", "jaar").distinct(), ["lijst", "jaar"], "left_semi").join(new, _EDITION, "left_anti")
    kept = written(years.unionByName(new), "grootboek")
    kept.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lijst", "jaar").parquet(ledger)


def ingest(spark: SparkSession, landing: str, entries: str, ledger: str, rejected: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Takes in what has arrived in `landing` (Parquet of DELIVERY) since the last run, at most `files` files a batch, and ends. What
    was read is kept in `checkpoint`, so a run that was cut off goes on where it was."""
    arrived = spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", files).parquet(landing)
    take = lambda batch, number: ingest_batch(batch, number, entries, ledger, rejected)
    return arrived.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_published(deliveries: DataFrame) -> DataFrame:
    """(lijst, jaar, week): the latest week that the source itself tells of each chart."""
    latest = deliveries.where("pagina_jaar is not null and pagina_week is not null").groupBy("lijst").agg(F.max(F.struct("pagina_jaar", "pagina_week")).alias("x"))
    return latest.select("lijst", F.col("x.pagina_jaar").alias("jaar"), F.col("x.pagina_week").alias("week"))


def still_to_fetch(ledger: DataFrame, absent: DataFrame, published: DataFrame, last: int = 53) -> DataFrame:
    """ledger, absent(lijst, jaar, week), published(lijst, jaar, week) -> the editions to ask for: of the source's running year all
    up to the published week, of the year before those after its last known week (if any is known)."""
    have = ledger.select(*_EDITION).unionByName(absent.select(*_EDITION)).distinct()
    now = published.select("lijst", "jaar", F.explode(F.sequence(F.lit(1), "week")).alias("week"))
    before = ledger.groupBy("lijst", "jaar").agg(F.max("week").alias("hoogste")).where(F.col("hoogste") < last)
    tail = before.join(published.select("lijst", (F.col("jaar") - 1).alias("jaar")), ["lijst", "jaar"]).select("lijst", "jaar", F.explode(F.sequence(F.col("hoogste") + 1, F.lit(last))).alias("week"))
    return now.unionByName(tail).join(have, _EDITION, "left_anti")


def import_years(rows: DataFrame, entries: str) -> None:
    """rows(lijst, jaar, week, positie, titel, artiest, sleutel) of an annual file: its chart-years are replaced as a whole, all
    editions of a year together; others stay."""
    write_entries(rows.select(*ENTRY_SCHEMA.names), entries)
