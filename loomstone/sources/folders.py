"""The folder that all executors share: where lineage is cut and files lie that queries write and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session's default file system resolves it."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toString()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or setCheckpointDir names; unset, a temporary one in local mode (tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        if not known:
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        named = spark.sparkContext.getCheckpointDir().rstrip("/").rpartition("/")[0]
    return qualified(spark, named).rstrip("/")


def shared(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """The same rows, written as a table to the shared folder and read from there; its size is known to the plans that read it."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
