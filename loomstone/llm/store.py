"""Cutting lineage and keeping files where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session's default file system resolves it."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toString()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, a temporary one in local mode (tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        if not known:
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        named = spark.sparkContext.getCheckpointDir().rstrip("/").rpartition("/")[0]
    return qualified(spark, named).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def settle_table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a table in the shared folder: smaller than a checkpoint where rows are many and narrow."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clashing(docs: DataFrame) -> bool:
    """Whether two rows share an id or a row has none."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return bool(ids.where("doc_id IS NULL OR n > 1").limit(1).count())


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): an id that only one row has, the text, and a struct of all other columns and the given id.

    The given ids serve where no two rows share one and none is null; else numbers replace them all, settled, since they hold
    for one reading only.
    """
    rest = [F.col(c) for c in docs.columns if c != "text"]
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*rest).alias("row"))
    if not clashing(docs):
        return packed
    return settle(packed.withColumn("doc_id", F.monotonically_increasing_id()))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(path: str):
    """(file system, path in it) of a qualified path, for binary files that Spark has no writer for."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        raise ValueError(f"{path} names no file system")
    return fs.FileSystem.from_uri(path)
