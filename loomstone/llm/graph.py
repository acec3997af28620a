"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.store import settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that it is connected to.

    Alternates the large-star and small-star steps until every edge points at
    a root.  Each step is a minimum per node, which is combined before the
    shuffle, and a join that brings it back to the node's edges, which AQE may
    split; no neighbourhood is gathered.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        after = settle(small)
        # settled when every upper node has one edge and no root is itself an upper node
        open_edges = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        if not open_edges and not after.groupBy("u").count().where("count > 1").limit(1).count():
            now = after
            break
        now = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
