"""Shared helpers: reading tables, cutting lineage in the cluster's shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of bytes other than space and \t \n \v \f \r, in Java and in Python.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The top-level column of that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@lru_cache(1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one of this machine - in local mode only: on
    a cluster executors would write to folders of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


#: Shuffle files go as soon as the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and executors may be lost. What was written
    holds the result, so the shuffle files behind it aren't kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes what materialize wrote for these, once nothing is read from them any more."""
    for df in written:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*parts: Column | str) -> Column:
    """A hash below 2**60 that any SQL engine with md5 can repeat; parts are joined by a colon, null is empty."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in the order (from 1), without a sort in one task.

    Rows are dealt out by range and written; the driver gets the row count of each range only.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    ends, total = [], 0
    for p, count in sorted(part.groupBy("__part").count().collect()):
        ends.append((p, total))
        total += count
    base = spark.createDataFrame(ends, "__part int, __before long")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return part.withColumn("__own", own).join(F.broadcast(base), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null: empty) and the offsets of its n + 1 row ends."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive row slices of about `limit` bytes of text, so that scratch arrays stay small."""
    _, ends = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
