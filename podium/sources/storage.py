"""Tables written once in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of this machine where that is unset, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _local()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: lineage is cut, and executors may be lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, whatever file system it lies in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` wrote for these, once nothing is read from them any more."""
    for df in tables:
        remove(df.sparkSession, df._written)
