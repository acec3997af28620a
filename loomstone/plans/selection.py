"""Selection and planning queries: documents are chunks of two to a page, their sources the documents that pages belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import chunking, planning, selection
from loomstone.plans.retrieval import pool
from loomstone.plans.shared import Catalogue
from loomstone.sources.tables import table

area = Catalogue()

NEAR = selection.Bounds(radius=2, chunks=9, pages=4, tokens=600)
LIMITS = planning.Limits(cards=4, input_target=1500, pack_tokens=1000, pack_chunks=8, reserve=416, summary_tokens=64)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("document"), F.floor(F.col("doc_id") / 2).alias("page"), F.col("doc_id").alias("chunk"), tx.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"), "text")


@area.plan(f"""
    WITH RECURSIVE c AS (SELECT vec_id // 64 AS document, vec_id // 2 AS page, vec_id AS chunk, 20 + vec_id * 7 % 90 AS tokens FROM embeddings),
    a AS (SELECT chunk // 100 AS query_id, chunk AS anchor, document, page, tokens, row_number() OVER (PARTITION BY chunk // 100 ORDER BY chunk) AS ordinal FROM c WHERE chunk % 33 = 0),
    h AS (SELECT query_id, count(*) AS taken, {NEAR.tokens} - sum(tokens) AS room, list(DISTINCT document || ':' || page) AS pages FROM a GROUP BY query_id),
    m AS (SELECT a.query_id, c.chunk, c.document, c.page, c.tokens, a.anchor, a.ordinal, abs(c.page - a.page) AS distance, row_number() OVER (PARTITION BY a.query_id, c.chunk ORDER BY abs(c.page - a.page), a.ordinal) AS best
          FROM a JOIN h USING (query_id) JOIN c ON c.document = a.document AND abs(c.page - a.page) <= {NEAR.radius} AND c.tokens <= h.room WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.query_id = a.query_id AND x.anchor = c.chunk)),
    n AS (SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY distance, ordinal, page, chunk) AS n FROM m WHERE best = 1),
    k AS (SELECT n.* FROM n JOIN h USING (query_id) WHERE n.n <= {NEAR.chunks} - taken),
    w AS (
      SELECT query_id, CAST(0 AS BIGINT) AS n, pages, CAST(room AS BIGINT) AS room, 0 AS place, false AS kept FROM h WHERE len(pages) <= {NEAR.pages} AND room > 0 AND taken <= {NEAR.chunks}
      UNION ALL
      SELECT query_id, n, CASE WHEN fits AND NOT known THEN list_append(pages, p) ELSE pages END, room - CASE WHEN fits THEN tokens ELSE 0 END, place + CASE WHEN fits THEN 1 ELSE 0 END, fits FROM (
        SELECT *, (known OR len(pages) < {NEAR.pages}) AND tokens <= room AS fits FROM (
          SELECT w.query_id, k.n, w.pages, w.room, w.place, k.tokens, k.document || ':' || k.page AS p, list_contains(w.pages, k.document || ':' || k.page) AS known FROM w JOIN k ON k.query_id = w.query_id AND k.n = w.n + 1)))
    SELECT w.query_id, place, chunk, anchor, distance, document, page, tokens FROM w JOIN k USING (query_id, n) WHERE kept""")
def neighbor_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("document"), F.floor(F.col("vec_id") / 2).alias("page"), F.col("vec_id").alias("chunk"), (F.col("vec_id") * 7 % 90 + 20).alias("tokens"))
    """Every hundred vectors are a query, and every thirty-third vector an anchor; documents have 32 pages of two."""
    picked = chunks.where("chunk % 33 = 0").withColumn("query_id", F.floor(F.col("chunk") / 100))
    anchors = picked.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk")))
    return selection.expand(anchors, chunks, NEAR)


@area.plan()
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, each asking the first line of its own document."""
    chunks = _chunks(spark, sf_dir)
    ranked = pool(spark, sf_dir).select("query_id", "rank", F.col("vec_id").alias("chunk")).join(chunks, "chunk")
    question = F.first(F.substring_index("text", "\n", 1)).over(Window.partitionBy("query_id").orderBy("rank"))
    ranked = ranked.withColumn("question", question).withColumn("fusion_score", F.lit(1.0) / (60 + F.col("rank"))).drop("text")
    written = chunks.groupBy("document", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return selection.candidate_pool(ranked, chunks, written)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), 300, 40)


@area.plan()
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve cards from every document, in requests of four."""
    asked = planning.sized(_pieces(spark, sf_dir)).withColumns({"asked": F.lit(0), "got": F.lit(0), "whole": F.lit(False)})
    return planning.batches(planning.allocate(asked, "doc_id", 12), ["doc_id"], LIMITS)


@area.plan()
def preflight_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.preflight(_pieces(spark, sf_dir), "doc_id", 12, LIMITS)


area.sql(
    "study_options",
    """
    SELECT p_partkey, array_join(transform(array_sort(transform(array(p_name, p_brand, p_type, CAST(p_size AS STRING)), (o, i) -> struct(md5(concat(p_partkey, ':', i)) AS k, o AS o))), x -> x.o), '|') AS shown FROM {part}""",
    """
    SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform([p_name, p_brand, p_type, CAST(p_size AS STRING)], lambda o, i: {'k': md5(concat(p_partkey, ':', i - 1)), 'o': o})), lambda x: x.o), '|') AS shown FROM part""",
)
