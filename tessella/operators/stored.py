"""Tables written between jobs, in a folder that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local master takes a temporary folder; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local()
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tables-')}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a table that is read back: it is computed once, and its lineage ends here."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def freed(spark: SparkSession) -> None:
    """Let go of the shuffle files of queries that nothing refers to; Spark removes them when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def exists(spark: SparkSession, folder: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
