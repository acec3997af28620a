"""Retrieval queries: documents stand for pages, their source for the document, embeddings for chunk vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.functions import vectors as vec
from loomstone.operators import evidence, retrieval, search
from loomstone.plans.shared import Catalogue
from loomstone.sources.tables import table

area = Catalogue()
QUERY_ID, TERMS = 7, ["with", "the"]
POLICY = retrieval.Policy(least_similarity=0.1, lexical_any=True)

_FOLD = "replace(lower(text), 'ß', 'ss')"
_WORDS = f"regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}_]+')"
_HITS = f"len(list_filter({_WORDS}, lambda x: x IN ('with', 'the')))"
_TOKENS = r"CAST(CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 3), ceil(strlen(text) / 4), len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) END AS BIGINT)"
_LEXICAL = f"""
    lexical AS (
      SELECT doc_id, lexical_score, row_number() OVER (ORDER BY lexical_score DESC, doc_id) AS lexical_rank FROM (
        SELECT doc_id, round(h * 0.1 / (h * 0.1 + 1), 9) AS lexical_score FROM (SELECT doc_id, {_HITS} AS h FROM chunks) WHERE h > 0)
      ORDER BY lexical_score DESC, doc_id LIMIT 20)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return table(spark, sf_dir, "documents").join(vectors, "doc_id")


@area.plan(f"""
    WITH chunks AS (SELECT doc_id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
    q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = {QUERY_ID}),
    vector AS (
      SELECT doc_id, similarity, row_number() OVER (ORDER BY similarity DESC, doc_id) AS vector_rank FROM (
        SELECT doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS similarity FROM chunks, q)
      WHERE similarity >= 0.1 ORDER BY similarity DESC, doc_id LIMIT 20),{_LEXICAL},
    fused AS (
      SELECT doc_id, max(similarity) AS similarity, max(lexical_score) AS lexical_score, min(vector_rank) AS vector_rank, min(lexical_rank) AS lexical_rank,
             round(sum(coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0)), 9) AS fusion_score
      FROM (SELECT doc_id, similarity, NULL AS lexical_score, vector_rank, NULL AS lexical_rank FROM vector
            UNION ALL SELECT doc_id, NULL, lexical_score, NULL, lexical_rank FROM lexical) GROUP BY doc_id)
    SELECT doc_id, similarity, CAST(lexical_score AS DOUBLE) AS lexical_score, CAST(coalesce(vector_rank, 0) AS INT) AS vector_rank, CAST(coalesce(lexical_rank, 0) AS INT) AS lexical_rank, CAST(fusion_score AS DOUBLE) AS fusion_score,
           CAST(row_number() OVER (ORDER BY fusion_score DESC, least(coalesce(vector_rank, 2147483647), coalesce(lexical_rank, 2147483647)), coalesce(vector_rank, 2147483647), coalesce(lexical_rank, 2147483647), doc_id) AS INT) AS position
    FROM fused""")
def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).first()
    vector = list(wanted["embedding"]) if wanted else []  # an unknown query finds by its words alone
    return retrieval.hybrid(_chunks(spark, sf_dir), vector, TERMS, POLICY)


@area.plan(f"WITH chunks AS (SELECT doc_id, text FROM documents),{_LEXICAL} SELECT doc_id, CAST(lexical_score AS DOUBLE) AS lexical_score, CAST(lexical_rank AS INT) AS lexical_rank FROM lexical")
def lexical_only_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_channel(table(spark, sf_dir, "documents"), TERMS, POLICY)


@area.plan(f"""
    SELECT document, page, CAST(page_rank AS DOUBLE) AS page_rank, CAST(row_number() OVER (ORDER BY page_rank DESC, page) AS INT) AS position FROM (
      SELECT source AS document, doc_id AS page, max(round(h * 0.1 / (h * 0.1 + 1), 9)) AS page_rank
      FROM (SELECT source, doc_id, {_HITS.replace("lower(text)", "lower(concat_ws(' ', lang, text))")} AS h FROM documents) WHERE h > 0 GROUP BY source, doc_id)
    ORDER BY page_rank DESC, page LIMIT 20""")
def page_search_max_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.col("lang").alias("section"), "text")
    return retrieval.best_per_page(pages, TERMS, 20)


_TOPK = """
    near AS (
      SELECT q.vec_id AS query_id, b.vec_id, b.label, q.label AS query_label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
      FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM near) WHERE rank <= 20)"""


def pool(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """The stated query set (ids divisible by 100) against all vectors, or all of ``among`` (vec_id), twenty candidates each."""
    base = table(spark, sf_dir, "embeddings")
    queries = base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vec.top_k(queries, base if among is None else base.join(among, "vec_id", "left_semi"), 20)


@area.plan(f"WITH {_TOPK} SELECT query_id, vec_id, similarity, CAST(rank AS INT) AS rank FROM top")
def multi_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir)


def _pool_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", "lang")
    return pool(spark, sf_dir, docs.select("vec_id")).join(docs, "vec_id")  # what has no text takes no place


@area.plan()
def bounded_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool_texts(spark, sf_dir).select("query_id", "rank", F.col("vec_id").alias("chunk"), F.col("source").alias("document"), F.lit(1).alias("page"), "text", tx.token_estimate(F.col("text")).alias("tokens"))
    return retrieval.select_bounded(pool, retrieval.Policy(context_tokens=4096, across_documents=True))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: the words 11 to 13 of every document whose id is divisible by 100."""
    words = F.array_join(F.slice(F.split("text", r"\s+"), 11, 3), " ")
    return table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), words.alias("question"))


_ASKED_TERMS = f"""
    q AS (SELECT doc_id AS query_id, replace(lower(array_to_string(regexp_split_to_array(text, '\\s+')[11:13], ' ')), 'ß', 'ss') AS question FROM documents WHERE doc_id % 100 = 0),
    qw AS (SELECT query_id, regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+') AS w FROM q),
    qk AS (SELECT query_id, list_filter(list_distinct(w), lambda x: x NOT IN ({", ".join(repr(w) for w in tx.STOP_WORDS)})) AS kept, w FROM qw),
    t AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n_terms FROM (SELECT query_id, CASE WHEN len(kept) > 0 THEN kept ELSE list_distinct(w) END AS terms FROM qk)),
    p AS (SELECT doc_id, unnest({_WORDS}) AS term, unnest(range(len({_WORDS}))) AS place FROM documents),
    e AS (SELECT query_id, doc_id, term, n_terms, place, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY place) AS k FROM p JOIN t USING (term))"""
_ANY_TOP = """
    anyof AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, doc_id) AS lexical_rank FROM (
        SELECT query_id, doc_id, round(count(*) * 0.1::DOUBLE / (count(*) * 0.1::DOUBLE + 1), 9) AS lexical_score FROM e GROUP BY query_id, doc_id)) WHERE lexical_rank <= 20)"""


@area.plan(f"WITH {_ASKED_TERMS},{_ANY_TOP} SELECT query_id, doc_id, lexical_score, CAST(lexical_rank AS INT) AS lexical_rank FROM anyof")
def questions_any_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the stated set against all texts that hold one of its terms."""
    return search.lexical(_questions(spark, sf_dir), table(spark, sf_dir, "documents"))


@area.plan(f"""
    WITH {_ASKED_TERMS},
    whole AS (SELECT query_id, doc_id FROM e GROUP BY query_id, doc_id, n_terms HAVING count(DISTINCT term) = n_terms),
    seen AS (
      SELECT e.query_id, e.doc_id, e.k, e.place, max(x.k) AS last FROM e JOIN whole USING (query_id, doc_id)
      JOIN e x ON x.query_id = e.query_id AND x.doc_id = e.doc_id AND x.k <= e.k GROUP BY e.query_id, e.doc_id, e.k, e.place, e.n_terms, x.term),
    low AS (SELECT query_id, doc_id, k, place, CASE WHEN count(*) = (SELECT any_value(n_terms) FROM t WHERE t.query_id = seen.query_id) THEN min(last) END AS low FROM seen GROUP BY query_id, doc_id, k, place),
    moved AS (SELECT *, lag(low) OVER (PARTITION BY query_id, doc_id ORDER BY k) AS before FROM low),
    c AS (SELECT m.query_id, m.doc_id, 0.1::DOUBLE / (1 + m.place - b.place - (m.k - m.low)) AS gain FROM moved m JOIN e b ON b.query_id = m.query_id AND b.doc_id = m.doc_id AND b.k = m.low WHERE m.low > coalesce(m.before, 0)),
    s AS (SELECT query_id, doc_id, round(sum(gain) / (sum(gain) + 1), 9) AS lexical_score FROM c GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, lexical_score, CAST(n AS INT) AS lexical_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, doc_id) AS n FROM s) WHERE n <= 20""")
def questions_all_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the stated set against all texts that hold all of its terms, ranked by their minimal covers."""
    return search.lexical(_questions(spark, sf_dir), table(spark, sf_dir, "documents"), every=True)


@area.plan(f"""
    WITH {_ASKED_TERMS},{_ANY_TOP}, {_TOPK},
    b AS (SELECT query_id, vec_id AS doc_id, similarity, NULL AS lexical_score, rank AS vector_rank, NULL AS lexical_rank FROM top WHERE similarity >= 0.1
          UNION ALL SELECT query_id, doc_id, NULL, lexical_score, NULL, lexical_rank FROM anyof),
    f AS (SELECT query_id, doc_id, max(similarity) AS similarity, max(lexical_score) AS lexical_score, min(vector_rank) AS v, min(lexical_rank) AS x,
                 round(sum(coalesce(1::DOUBLE / (60 + vector_rank), 0) + coalesce(1::DOUBLE / (60 + lexical_rank), 0)), 9) AS fusion_score FROM b GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, similarity, CAST(lexical_score AS DOUBLE) AS lexical_score, CAST(coalesce(v, 0) AS INT) AS vector_rank, CAST(coalesce(x, 0) AS INT) AS lexical_rank, fusion_score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, least(coalesce(v, 2147483647), coalesce(x, 2147483647)), coalesce(v, 2147483647), coalesce(x, 2147483647), doc_id) AS INT) AS position FROM f""")
def questions_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors and the words of the stated set, fused by question."""
    near = pool(spark, sf_dir).where("similarity >= 0.1").select("query_id", F.col("vec_id").alias("doc_id"), "similarity", F.col("rank").alias("vector_rank"))
    return search.fused(near, questions_any_topk(spark, sf_dir))


_SETS = f"""
    s AS (SELECT doc_id, lang, source, list_sort(list_distinct({_WORDS})) AS w, min(doc_id) OVER (PARTITION BY lang, source, list_sort(list_distinct({_WORDS}))) AS class_id FROM documents),
    r AS (SELECT * FROM s WHERE doc_id = class_id AND len(w) > 0),
    m AS (SELECT a.doc_id AS x, b.doc_id AS y, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS p, len(b.w) AS q FROM r a JOIN r b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id)"""
_LINKS = "SELECT s.doc_id, s.class_id, coalesce(l.n, 0) AS links FROM s LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT x AS k FROM p UNION ALL SELECT y FROM p) GROUP BY k) l ON l.k = s.class_id"


@area.plan(f"WITH {_SETS}, p AS (SELECT x, y FROM m WHERE c >= 0.8 * least(p, q) - 1e-9) {_LINKS}")
def containment_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.similar_sets(table(spark, sf_dir, "documents"), "doc_id", ["lang", "source"], "text", 0.8, contained=True)


@area.plan(f"WITH {_SETS}, p AS (SELECT x, y FROM m WHERE c >= 0.8 * (p + q - c) - 1e-9) {_LINKS}")
def jaccard_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.similar_sets(table(spark, sf_dir, "documents"), "doc_id", ["lang", "source"], "text", 0.8)


@area.plan(f"""
    SELECT doc_id, CAST(lexical_score AS DOUBLE) AS lexical_score, CAST(row_number() OVER (ORDER BY lexical_score DESC, doc_id) AS INT) AS lexical_rank FROM (
      SELECT doc_id, round(h * 0.1 / (h * 0.1 + 1), 9) AS lexical_score FROM (SELECT doc_id, {_HITS} AS h FROM documents WHERE list_contains({_WORDS}, 'with') AND list_contains({_WORDS}, 'the')))
    ORDER BY lexical_score DESC, doc_id LIMIT 20""")
def lexical_all_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold every term."""
    return retrieval.lexical_channel(table(spark, sf_dir, "documents"), TERMS, retrieval.Policy())


@area.plan()
def grounded_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _pool_texts(spark, sf_dir).select(F.col("query_id").alias("job"), F.col("rank").alias("ordinal"), F.col("vec_id").alias("card"), F.substring_index("text", "\n", 1).alias("question"), F.substring_index("text", ".", 1).alias("answer"))
    return evidence.distinct_cards(cards)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every stated query, whose question is the first line of its own document, be that a candidate or not."""
    own = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.substring_index("text", "\n", 1).alias("question"))
    pool = _pool_texts(spark, sf_dir).join(own.groupBy("query_id").agg(F.min("question").alias("question")), "query_id", "left")
    return pool.select("query_id", "rank", F.col("source").alias("document"), F.col("vec_id").alias("page"), "question", "text")


@area.plan()
def best_excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.excerpts(_asked(spark, sf_dir)).drop("n_terms")


@area.plan()
def related_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.related_excerpts(_asked(spark, sf_dir))


@area.plan()
def source_first_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.source_first_excerpts(_asked(spark, sf_dir))


area.sql(
    "eligible_chunks",
    """
    SELECT d.doc_id, d.source, e.label FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id JOIN {embeddings} e ON e.vec_id = d.doc_id
    WHERE l.quality = 1 AND l.toxic = 0 AND size(e.embedding) = 64""",
    """
    SELECT d.doc_id, d.source, e.label FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN embeddings e ON e.vec_id = d.doc_id
    WHERE l.quality = 1 AND l.toxic = 0 AND len(e.embedding) = 64""",
)
area.sql(
    "all_or_nothing_scope",
    """
    SELECT source, lang, count(DISTINCT d.doc_id) AS selected, count(DISTINCT l.doc_id) AS visible, count(DISTINCT d.doc_id) = count(DISTINCT l.doc_id) AS granted
    FROM {documents} d LEFT JOIN (SELECT doc_id FROM {labels} WHERE toxic = 0) l ON l.doc_id = d.doc_id GROUP BY source, lang""",
)


@area.plan("""
    WITH a AS (SELECT label, vec_id AS anchor, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS ordinal FROM embeddings),
    anchors AS (SELECT * FROM a WHERE ordinal <= 3)
    SELECT document, page, chunk, anchor, CAST(ordinal AS INT) AS ordinal, distance FROM (
      SELECT e.label AS document, e.vec_id AS page, e.vec_id AS chunk, anchor, ordinal, abs(e.vec_id - anchor) AS distance,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY abs(e.vec_id - anchor), ordinal, anchor) AS n
      FROM embeddings e JOIN anchors k ON k.label = e.label WHERE abs(e.vec_id - anchor) <= 40 AND e.vec_id NOT IN (SELECT anchor FROM anchors)) WHERE n = 1""")
def neighbor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").select(F.col("label").alias("document"), F.col("vec_id").alias("page"), F.col("vec_id").alias("chunk"))
    first = chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("document").orderBy("chunk"))).where("ordinal <= 3")
    return retrieval.neighbours(first, chunks, 40)


@area.plan(f"""
    SELECT source, doc_id, tokens, CAST(n AS INT) AS page_rank, running AS running_tokens FROM (
      SELECT source, doc_id, tokens, row_number() OVER w AS n, CAST(sum(tokens) OVER w AS BIGINT) AS running FROM (SELECT source, doc_id, {_TOKENS} AS tokens FROM documents)
      WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE n <= 12 AND running <= 8192""")
def page_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 12")
    pages = first.select("source", "doc_id", tx.token_estimate(F.col("text")).alias("tokens"))
    return retrieval.prefix_budget(pages, ["source"], ["doc_id"], 12, 8192)


@area.plan(f"""
    WITH {_TOPK}, rel AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    k AS (SELECT query_id, query_label, count(*) FILTER (label = query_label AND rank <= 5) AS hit, min(rank) FILTER (label = query_label AND vec_id <> query_id) AS first_rank FROM top GROUP BY query_id, query_label)
    SELECT count(*) AS cases, round(avg(hit / least(5, n)), 6) AS recall_at_5, round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM k JOIN rel ON rel.label = query_label""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.operators import evaluation

    return evaluation.metrics(pool(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5)


@area.plan(f"""
    WITH {_TOPK}, p AS (SELECT * FROM (VALUES ('floor_0', 0.0), ('floor_1', 0.1), ('floor_2', 0.2), ('floor_3', 0.3), ('floor_5', 0.5)) v(policy, least)),
    k AS (SELECT policy, query_id, count(*) AS kept, count(*) FILTER (label = query_label) AS same FROM top, p WHERE similarity >= least GROUP BY policy, query_id)
    SELECT policy, count(*) AS answered, CAST(sum(kept) AS BIGINT) AS kept, round(avg(same / kept), 6) AS precision FROM k GROUP BY policy""")
def policy_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.operators import evaluation

    floors = {"floor_0": 0.0, "floor_1": 0.1, "floor_2": 0.2, "floor_3": 0.3, "floor_5": 0.5}
    return evaluation.ablation(pool(spark, sf_dir), table(spark, sf_dir, "embeddings"), floors)
