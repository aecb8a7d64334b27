"""Ranks over a whole table without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.sources.storage import written


def ranked(df: DataFrame, order: list[Column | str], name: str = "plek") -> DataFrame:
    """df with each row's place in the order, from 1; rows that are equal in the order take consecutive places in any order.

    Rows are dealt out by range and written, each range is ranked by itself, and what comes before a range is added: the
    driver gets one count a range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__deel", F.spark_partition_id()), "volgorde")
    before, starts = 0, []
    for part, n in sorted(dealt.groupBy("__deel").count().collect()):
        starts.append((part, before))
        before += n
    start = spark.createDataFrame(starts, "__deel int, __voor long")
    own = F.row_number().over(Window.partitionBy("__deel").orderBy(*order))
    return dealt.withColumn("__eigen", own).join(F.broadcast(start), "__deel").withColumn(name, (F.col("__voor") + F.col("__eigen")).cast("int" if before < 2**31 else "long")).drop("__deel", "__eigen", "__voor")


def in_parts(df: DataFrame, order: list[Column | str], size: int = 50_000, name: str = "deel") -> DataFrame:
    """df with plek and the part of at most `size` rows, from 1, that it falls into; all parts but the last are full."""
    return ranked(df, order).withColumn(name, (F.floor((F.col("plek") - 1) / F.lit(size)) + 1).cast("int"))
