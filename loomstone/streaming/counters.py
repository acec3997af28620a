"""Totals kept by signed changes instead of counting again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deltas(changes: DataFrame, scopes: dict[str, str | None], before: str, after: str) -> DataFrame:
    """(scope, scope_id, rows_delta, bytes_delta) of every change and scope, from the sizes before and after it (null: no row).

    ``scopes`` names the column of each scope; None is the scope of all.
    """
    there = lambda c: F.col(c).isNotNull().cast("long")
    size = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    of = F.array(*[F.struct(F.lit(s).alias("scope"), (F.col(c) if c else F.lit("")).cast("string").alias("scope_id")) for s, c in scopes.items()])
    told = changes.select(F.explode(of).alias("at"), (there(after) - there(before)).alias("rows_delta"), (size(after) - size(before)).alias("bytes_delta"))
    return told.select("at.*", "rows_delta", "bytes_delta")


def merged(totals: DataFrame, changed: DataFrame) -> DataFrame:
    """Totals (scope, scope_id, rows_held, bytes_held) with the changes in them; a scope that holds nothing goes, but for that of all."""
    both = totals.union(changed.select("scope", "scope_id", "rows_delta", "bytes_delta"))
    summed = both.groupBy("scope", "scope_id").agg(F.sum("rows_held").alias("rows_held"), F.sum("bytes_held").alias("bytes_held"))
    return summed.where((F.col("scope_id") == "") | (F.col("rows_held") != 0) | (F.col("bytes_held") != 0))


TOTALS = "scope string, scope_id string, rows_held long, bytes_held long"


def keeper(folder: str, scopes: dict[str, str | None], before: str, after: str) -> Callable[[DataFrame, int], None]:
    """A sink for micro-batches of changes: version n of the totals is version n - 1 and batch n.

    A batch that is played again after a failure makes its version from the same one before, so every change counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(TOTALS).parquet(f"{folder}/totals-{number - 1}") if number else spark.createDataFrame([], TOTALS)
        merged(known, deltas(batch, scopes, before, after)).write.mode("overwrite").parquet(f"{folder}/totals-{number}")

    return write


def keep(stream: DataFrame, folder: str, scopes: dict[str, str | None], before: str, after: str) -> DataFrame:
    """Takes in all changes that are there and returns the totals after them."""
    spark = stream.sparkSession
    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keeper(folder, scopes, before, after)).start()
    query.awaitTermination()
    done = query.lastProgress
    return spark.read.schema(TOTALS).parquet(f"{folder}/totals-{done.batchId}") if done else spark.createDataFrame([], TOTALS)
