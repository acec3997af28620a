"""Ordered sums over groups of any size: rows lie in range buckets of about one size, so no group is one task's work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.sources.folders import settle


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``bucket``, the range of the order that they lie in, and ``place``, a number that grows with the order."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return settle(ranged.withColumn("bucket", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "placed")


def earlier(rows: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """Add for each ``new: column`` of ``sums`` the sum of the column over the earlier rows of the same group.

    Sums run inside a bucket; the sums of the buckets before come from a table of one row a group and bucket.
    """
    ahead = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "bucket").orderBy("place").rowsBetween(*ahead)
    held = rows.groupBy(*by, "bucket").agg(*[F.sum(c).alias(f"sum_{n}") for n, c in sums.items()])
    across = Window.partitionBy(*by).orderBy("bucket").rowsBetween(*ahead)
    offsets = held.select(*[F.col(b).alias(f"of_{b}") for b in (*by, "bucket")], *[F.coalesce(F.sum(f"sum_{n}").over(across), F.lit(0)).alias(f"off_{n}") for n in sums])
    own = rows.withColumns({f"in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = own.join(offsets, [own[b].eqNullSafe(offsets[f"of_{b}"]) for b in (*by, "bucket")])
    return joined.select(*rows.columns, *[(F.col(f"in_{n}") + F.col(f"off_{n}")).alias(n) for n in sums])
