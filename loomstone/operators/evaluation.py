"""Retrieval-quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _judged(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """Found rows with the labels of query and result."""
    own = labelled.select("vec_id", "label")
    asked = labelled.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return found.join(own, "vec_id").join(asked, "query_id")


def metrics(found: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """Cases, recall at k and mean reciprocal rank; a result is relevant if it has its query's label."""
    relevant = labelled.groupBy(F.col("label").alias("query_label")).agg(F.count("*").alias("n"))
    same = F.col("label") == F.col("query_label")
    case = _judged(found, labelled).groupBy("query_id", "query_label").agg(
        F.count_if(same & (F.col("rank") <= k)).alias("hit"),
        F.min(F.when(same & (F.col("vec_id") != F.col("query_id")), F.col("rank"))).alias("first_rank"),
    )
    recall = F.col("hit") / F.least(F.lit(k), F.col("n"))
    return case.join(relevant, "query_label").agg(F.count("*").alias("cases"), F.round(F.avg(recall), 6).alias(f"recall_at_{k}"), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


def ablation(found: DataFrame, labelled: DataFrame, floors: dict[str, float]) -> DataFrame:
    """The same cases under several similarity floors."""
    policies = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(v).alias("least")) for n, v in floors.items()])).alias("p")
    each = _judged(found, labelled).select("*", policies).where(F.col("similarity") >= F.col("p.least"))
    case = each.groupBy("p.policy", "query_id").agg(F.count("*").alias("kept"), F.count_if(F.col("label") == F.col("query_label")).alias("same"))
    return case.groupBy("policy").agg(F.count("*").alias("answered"), F.sum("kept").alias("kept"), F.round(F.avg(F.col("same") / F.col("kept")), 6).alias("precision"))


def nearest_rank_p95(values: list[float]) -> float:
    """The value at ceil(0.95 n), counted from one; 0 of nothing."""
    return sorted(values)[max(0, int(len(values) * 0.95 + 0.999999) - 1)] if values else 0.0
