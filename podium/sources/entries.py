"""Chart entries: the fact table (chart, year, week, position, title, artist, key) and how TPC-H-like tables become one."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from podium.sources.storage import shared_dir, written

ENTRY_SCHEMA = StructType(
    [
        StructField("lijst", StringType()),
        StructField("jaar", IntegerType()),
        StructField("week", IntegerType()),
        StructField("positie", IntegerType()),
        StructField("titel", StringType()),
        StructField("artiest", StringType()),
        StructField("sleutel", StringType()),
    ]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned entry table written by write_entries."""
    return spark.read.schema(ENTRY_SCHEMA).parquet(path)


def write_entries(entries: DataFrame, path: str) -> None:
    """Replaces the (chart, year) partitions that entries has and leaves the others."""
    entries.repartition("lijst", "jaar").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lijst", "jaar").parquet(path)


def replace_weeks(spark: SparkSession, path: str, weeks: DataFrame) -> None:
    """Replaces the (chart, year, week) editions that weeks has in a table of write_entries, so that a replay changes nothing.

    Only the chart-years concerned are read and written again.
    """
    editions = weeks.select("lijst", "jaar", "week").distinct()
    kept = read_entries(spark, path).join(editions.select("lijst", "jaar").distinct(), ["lijst", "jaar"], "left_semi").join(editions, ["lijst", "jaar", "week"], "left_anti")
    # written aside first: a partition can't be overwritten while it is read
    write_entries(written(kept.unionByName(weeks.select(*ENTRY_SCHEMA.names)), "weken"), path)


def chart_entries(spark: SparkSession, sf_dir: str, rows: int = 250_000) -> DataFrame:
    """Weekly charts by return flag (40 places) and annual charts by line status (500 places), ranked by quantity sold.

    Quantities are summed before the join with part, and each branch is cut to its literal number of places, which tasks do
    before they shuffle. Lines are dealt out by edition and part, about `rows` to a task: nearly each has a sum of its own, so a
    task that took what a file split or a fixed number of partitions gives it would hold more with every line there is. An edition
    goes to no more tasks than the fullest one needs, as each sends all its places.
    """
    day = F.to_date("l_shipdate")
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus", day.alias("d"))
    saturday = F.next_day(F.date_sub("d", 1), "SAT")
    weekly = lines.select("l_partkey", "l_quantity", F.concat(F.lit("wk_"), "l_returnflag").alias("lijst"), F.year(saturday).alias("jaar"), F.floor((F.dayofyear(saturday) + 6) / 7).cast("int").alias("week"))
    annual = lines.select("l_partkey", "l_quantity", F.concat(F.lit("jr_"), "l_linestatus").alias("lijst"), F.year("d").alias("jaar"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // rows))  # counted from the files' footers
    ranked = _first(weekly, 40, tasks, rows).unionByName(_first(annual, 500, tasks, rows).withColumn("week", F.lit(52)))
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("titel"), F.col("p_brand").alias("artiest"))
    key = F.concat(F.replace(F.lower("artiest"), F.lit("#"), F.lit(" ")), F.lit("|"), F.lower("titel"))
    return ranked.join(part, F.col("l_partkey") == F.col("p_partkey")).select("lijst", "jaar", "week", "positie", "titel", "artiest", key.alias("sleutel"))


def _dealt(sold: DataFrame, edition: list[str], tasks: int, rows: int) -> DataFrame:
    """sold with deel, the piece of its edition that a row belongs to; a piece lies in one task."""
    fullest = sold.groupBy(*edition).count().agg(F.max("count")).first()[0] or 0
    # an eighth of a task's rows to a piece, so that pieces that fall together don't make a task much larger than others
    piece = F.pmod(F.hash("l_partkey"), F.lit(max(1, -(-fullest * 8 // rows))))
    return sold.withColumn("deel", piece).repartition(tasks, *edition, "deel")


def _first(sold: DataFrame, places: int, tasks: int, rows: int) -> DataFrame:
    edition = [c for c in sold.columns if c not in ("l_quantity", "l_partkey")]
    summed = _dealt(sold, edition, tasks, rows).groupBy(*edition, "deel", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    order = Window.partitionBy(*edition).orderBy(F.desc("q"), "l_partkey")
    return summed.drop("deel").withColumn("positie", F.row_number().over(order)).where(F.col("positie") <= places)


@lru_cache(32)
def _archive(application: str, shared: str, sf_dir: str) -> str:
    spark = SparkSession.getActiveSession()
    path = f"{shared}/archief-{uuid.uuid4().hex}"
    write_entries(chart_entries(spark, sf_dir), path)
    return path


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chart_entries as a partitioned table, written once for each application and folder."""
    return read_entries(spark, _archive(spark.sparkContext.applicationId, shared_dir(spark), sf_dir))


def with_source_columns(entries: DataFrame) -> DataFrame:
    """entries with what a source page tells besides: vorige_positie (in the chart's edition before), site_status (nieuw, terug,
    stijger, daler, gelijk) and weken_genoteerd (editions so far)."""
    calendar = entries.select("lijst", "jaar", "week").distinct().withColumn("idx", F.row_number().over(Window.partitionBy("lijst").orderBy("jaar", "week")))
    order = Window.partitionBy("lijst", "sleutel").orderBy("idx", "positie")
    rows = entries.join(calendar, ["lijst", "jaar", "week"])
    rows = rows.withColumn("voor", F.lag("idx").over(order)).withColumn("vorige_positie", F.when(F.col("voor") == F.col("idx") - 1, F.lag("positie").over(order)))
    step = F.col("vorige_positie") - F.col("positie")
    status = F.when(F.col("voor").isNull(), "nieuw").when(step.isNull(), "terug").when(step > 0, "stijger").when(step < 0, "daler").otherwise("gelijk")
    return rows.withColumn("site_status", status).withColumn("weken_genoteerd", F.row_number().over(order)).drop("voor")


#: The same view in SQL, as common table expressions.
ENTRIES_SQL = """
li as (select l_partkey, l_quantity, l_returnflag, l_linestatus, cast(l_shipdate as date) d from lineitem),
ws as (select l_partkey, l_quantity, 'wk_' || l_returnflag lijst, d + cast((6 - dayofweek(d) + 7) % 7 as integer) sat from li),
sold as (
 select lijst, cast(year(sat) as integer) jaar, cast(floor((dayofyear(sat) + 6) / 7) as integer) as week, 40 places, l_partkey, cast(sum(l_quantity) as bigint) q from ws group by all
 union all
 select 'jr_' || l_linestatus, cast(year(d) as integer), 52, 500, l_partkey, cast(sum(l_quantity) as bigint) from li group by all),
rk as (select *, row_number() over (partition by lijst, jaar, week order by q desc, l_partkey) positie from sold),
e as (select lijst, jaar, week, cast(positie as integer) positie, p_name titel, p_brand artiest, replace(lower(p_brand), '#', ' ') || '|' || lower(p_name) sleutel
 from rk join part on l_partkey = p_partkey where positie <= places),
best as (select lijst, jaar, week, sleutel, min(positie) positie, arg_max(titel, positie) titel, arg_max(artiest, positie) artiest from e group by lijst, jaar, week, sleutel),
len as (select lijst, jaar, week, max(positie) lengte from e group by lijst, jaar, week),
scored as (select b.*, lengte, lengte - b.positie + 1 punten from best b join len using (lijst, jaar, week)),
cal as (select lijst, jaar, week, cast(row_number() over (partition by lijst order by jaar, week) as integer) idx from (select distinct lijst, jaar, week from e)),
seq as (select b.*, idx from best b join cal using (lijst, jaar, week)),
isl as (select *, idx - row_number() over (partition by lijst, sleutel order by idx) island from seq),
runs as (select lijst, sleutel, cast(min(idx) as integer) begin_idx, cast(max(idx) as integer) eind_idx, cast(count(*) as bigint) weken, min(positie) hoogste, arg_min(positie, idx) eerste_positie
 from isl group by lijst, sleutel, island),
src as (select *, case when voor is null then 'nieuw' when vorige_positie is null then 'terug' when vorige_positie > positie then 'stijger' when vorige_positie < positie then 'daler' else 'gelijk' end site_status from
 (select e.*, idx, lag(idx) over w voor, case when lag(idx) over w = idx - 1 then lag(positie) over w end vorige_positie, cast(row_number() over w as integer) weken_genoteerd from e join cal using (lijst, jaar, week) window w as (partition by lijst, sleutel order by idx, positie)))
"""
