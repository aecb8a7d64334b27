"""Snapshots of an entry table: manifests of chart-years, whose rows are stored once for each content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.sources.storage import remove, written

MANIFEST = "naam string, tijd timestamp, reden string, lijst string, jaar int, vinger string, rijen long"


def fingerprints(entries: DataFrame) -> DataFrame:
    """(lijst, jaar, vinger, rijen): the number of rows of a chart-year and sums of two hashes of theirs, whatever their order."""
    row = F.to_json(F.struct(*sorted(entries.columns)), {"ignoreNullFields": "false"})
    summed = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    each = entries.groupBy("lijst", "jaar").agg(F.count("*").alias("rijen"), summed(F.xxhash64(row)).alias("h1"), summed(F.xxhash64(F.lit(1), row)).alias("h2"))
    return each.select("lijst", "jaar", F.sha2(F.concat_ws(":", "rijen", "h1", "h2"), 256).alias("vinger"), "rijen")


def manifests(spark: SparkSession, store: str) -> DataFrame:
    """What each snapshot has: one row for each of its chart-years. Empty where nothing was stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifests")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifests")


def take_snapshot(entries: DataFrame, store: str, name: str, time: str, reason: str = "") -> DataFrame:
    """Stores the rows of chart-years that no snapshot has yet in that form, then the manifest of the whole table under `name`;
    returns the manifest. An empty table isn't stored. A repeat after a failure changes nothing: rows lie under their fingerprint
    and are written over, and a name is written over as a whole."""
    spark = entries.sparkSession
    own = written(fingerprints(entries), "vingers")
    if own.isEmpty():
        raise ValueError("an empty table has no snapshot")
    new = own.join(manifests(spark, store).select("lijst", "jaar", "vinger").distinct(), ["lijst", "jaar", "vinger"], "left_anti").select("lijst", "jaar", "vinger")
    rows = entries.join(F.broadcast(new), ["lijst", "jaar"])  # chart-years: some hundred short rows
    rows.repartition("lijst", "jaar").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lijst", "jaar", "vinger").parquet(f"{store}/rows")
    manifest = own.select(F.lit(name).alias("naam"), F.to_timestamp(F.lit(time)).alias("tijd"), F.lit(reason).alias("reden"), "lijst", "jaar", "vinger", "rijen")
    manifest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("naam").parquet(f"{store}/manifests")
    return manifest


def restore(spark: SparkSession, store: str, name: str, schema) -> DataFrame:
    """The table as of a snapshot; only the folders that its manifest names are read. An unknown name is an error."""
    own = manifests(spark, store).where(F.col("naam") == name).select("lijst", "jaar", "vinger")
    if own.isEmpty():
        raise ValueError(f"no snapshot {name}")
    stored = spark.read.option("basePath", f"{store}/rows").parquet(f"{store}/rows")
    kept = stored.withColumns({"lijst": F.col("lijst").cast("string"), "jaar": F.col("jaar").cast("int")}).join(F.broadcast(own), ["lijst", "jaar", "vinger"], "left_semi")
    return kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def to_keep(snapshots: DataFrame, now: str, newest: int = 12, days: int = 30) -> DataFrame:
    """snapshots(naam, tijd) -> those that stay: the `newest` ones and the first one of each of the last `days` days."""
    each = snapshots.select("naam", "tijd").distinct()
    age = each.withColumn("dag", F.to_date("tijd"))
    latest = each.orderBy(F.desc("tijd"), "naam").limit(newest)
    first = age.withColumn("n", F.row_number().over(Window.partitionBy("dag").orderBy("tijd", "naam"))).where((F.col("n") == 1) & (F.col("dag") > F.date_sub(F.to_date(F.lit(now)), days)))
    return latest.unionByName(first.select("naam", "tijd")).distinct()


def drop_old(spark: SparkSession, store: str, now: str, newest: int = 12, days: int = 30) -> list[str]:
    """Deletes the snapshots that to_keep leaves out, then the rows that no manifest names any more; the names that went."""
    all_ = manifests(spark, store)
    kept = written(to_keep(all_, now, newest, days), "blijven")
    gone = [r.naam for r in all_.select("naam").distinct().join(kept, "naam", "left_anti").collect()]
    held = written(all_.join(kept, ["naam"], "left_semi").select("lijst", "jaar", "vinger").distinct(), "gehouden")
    free = all_.select("lijst", "jaar", "vinger").distinct().join(held, ["lijst", "jaar", "vinger"], "left_anti").collect()
    for n in gone:
        remove(spark, f"{store}/manifests/naam={n}")
    for r in free:  # chart-years of dropped snapshots: folders, not rows
        remove(spark, f"{store}/rows/lijst={r.lijst}/jaar={r.jaar}/vinger={r.vinger}")
    return sorted(gone)
