"""Text queries: normalisation, terms, chunks, duplicates, grounding and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import chunking, evidence
from loomstone.plans.shared import Catalogue
from loomstone.sources import blocks, html
from loomstone.sources.tables import table

area = Catalogue()

_FOLD = "replace(lower({}), 'ß', 'ss')"
_NORM = r"trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\s+', ' ', 'g'))"
_WORDS = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"
_TOKENS = r"CAST(CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 3), ceil(strlen(text) / 4), len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) END AS BIGINT)"


@area.plan(f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@area.plan(f"SELECT doc_id, sha256({_NORM.format('text')}) AS evidence_hash, CAST(length({_NORM.format('text')}) AS INT) AS n_chars FROM documents")
def normalize_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = tx.normalize_evidence(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(body, 256).alias("evidence_hash"), F.char_length(body).alias("n_chars"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@area.plan(f"""
    SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w END[1:12], ' ') AS lexical_query FROM (
      SELECT doc_id, w, list_filter(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]), lambda x: x NOT IN ({_STOP})) AS k
      FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents))""")
def bounded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.bounded_terms(F.col("text"), 12), " ").alias("lexical_query"))


@area.plan(r"""
    SELECT doc_id, line, t <> '' AND length(t) <= 160 AND right(t, 1) NOT IN ('.', '!', '?', ';', ':') AND (
        regexp_matches(lower(t), '^(chapter|section|part|unit|lesson|module|appendix)\b|^\d+(\.\d+)*[.)]?\s+')
        OR len(p) <= 14 AND (regexp_matches(t, '\p{L}') AND regexp_extract_all(t, '\p{L}') = regexp_extract_all(t, '\p{Lu}') OR len(list_filter(p, lambda w: regexp_matches(w, '^\p{Lu}'))) >= greatest(1, ceil(len(p) * 0.8)))) AS is_heading
    FROM (SELECT doc_id, line, t, regexp_split_to_array(t, '\s+') AS p FROM (SELECT doc_id, line, trim(l) AS t FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)))""")
def heading_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "l"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), tx.heading(F.trim("l")).alias("is_heading"))


@area.plan(f"SELECT evidence_hash, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS latest_doc FROM (SELECT doc_id, sha256({_NORM.format('text')}) AS evidence_hash FROM documents) GROUP BY evidence_hash HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normalize_evidence(F.col("text")), 256).alias("evidence_hash"))
    return docs.groupBy("evidence_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("latest_doc")).where("copies > 1")


@area.plan("SELECT source, lang, sha256(text) AS content_hash, max(doc_id) AS latest_doc, arg_max(n_chars, doc_id) AS n_chars, count(*) AS revisions FROM documents GROUP BY source, lang, sha256(text)")
def latest_duplicate_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("text", 256))
    return docs.groupBy("source", "lang", "content_hash").agg(F.max("doc_id").alias("latest_doc"), F.max_by("n_chars", "doc_id").alias("n_chars"), F.count("*").alias("revisions"))


@area.plan()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), 300, 40)


def _words_and_signs(text: str) -> int:
    return len(text.split()) + sum(text.count(c) for c in ".,;:!?")


@area.plan()
def chunk_by_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 400 words and signs, counted by a function of the caller's."""
    return chunking.chunk(table(spark, sf_dir, "documents"), 400, 40, estimate=_words_and_signs)


@area.plan()
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several pages: a conversation's turns are its pages."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), "text")
    return chunking.chunk(turns, 60, 12)


@area.plan()
def pack_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pack(chunking.chunk(table(spark, sf_dir, "documents"), 300, 40).drop("text"), 1000, 8)


@area.plan(f"""
    WITH c AS (
      SELECT d.doc_id, coalesce(string_split(text, chr(10))[1], '') AS question, coalesce(string_split(text, chr(10))[2], '') AS quote, coalesce(string_split(string_split(text, chr(10))[2], '.')[1], '') AS answer,
             CASE WHEN l.doc_id IS NOT NULL THEN text END AS source, string_split(text, chr(10))[3:6] AS options FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),
    n AS (SELECT doc_id, {_NORM.format('question')} AS question, {_NORM.format('quote')} AS quote, {_NORM.format('answer')} AS answer, {_NORM.format('source')} AS source, list_transform(options, lambda o: {_NORM.format('o')}) AS options FROM c),
    r AS (SELECT *, CASE WHEN source IS NULL THEN 'unknown_source' WHEN quote = '' OR NOT contains(source, quote) THEN 'quote_not_contiguous' WHEN answer = '' OR NOT contains(quote, answer) THEN 'answer_not_in_quote'
      WHEN length(question) < 5 OR question = answer THEN 'unclear_question' WHEN list_contains(options, question) THEN 'option_matches_question' ELSE 'grounded' END AS outcome FROM n)
    SELECT doc_id, outcome, CASE WHEN outcome = 'grounded' THEN round_even(least(1.0, 0.75 + least(1.0, length(answer) / greatest(1, length(quote))) * 0.25), 4) ELSE 0 END AS quality FROM r""")
def grounding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of every document's first lines against the reviewed documents."""
    parts = F.split("text", "\n")
    line = lambda n: F.coalesce(F.get(parts, F.lit(n)), F.lit(""))
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    docs = table(spark, sf_dir, "documents").join(known, "doc_id", "left")
    cards = docs.select("doc_id", line(0).alias("question"), line(1).alias("quote"), F.substring_index(line(1), ".", 1).alias("answer"), F.slice(parts, 3, 4).alias("options"), F.when(F.col("known"), F.col("text")).alias("source"))
    return evidence.grounding(cards).select("doc_id", F.coalesce("rejection", F.lit("grounded")).alias("outcome"), F.coalesce("quality", F.lit(0.0)).alias("quality"))


@area.plan("""
    SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w, -1) AS user_turn, md5(coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w, '')) AS user_text
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def preceding_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    of_user = lambda c: F.last(F.when(F.col("role") == "user", F.col(c)), ignorenulls=True).over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(of_user("turn"), F.lit(-1)).alias("user_turn"), F.md5(F.coalesce(of_user("text"), F.lit(""))).alias("user_text"))


area.sql(
    "last_n_turns",
    """
    SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (
      SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {conversations}) t WHERE n <= 4""",
    """
    SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS position FROM (
      SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) t WHERE n <= 4""",
)
area.sql(
    "message_capacity",
    """
    SELECT conv_id, count(*) AS messages, count(CASE WHEN role = 'user' THEN 1 END) AS reserved, greatest(0, 12 - count(*) - count(CASE WHEN role = 'user' THEN 1 END)) AS remaining, count(*) + count(CASE WHEN role = 'user' THEN 1 END) <= 12 AS admitted
    FROM {conversations} GROUP BY conv_id""",
)


@area.plan()
def followup_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.followups(table(spark, sf_dir, "conversations"))


@area.plan()
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_text(table(spark, sf_dir, "pages"))


@area.plan("SELECT doc_id, CAST(ceil(greatest(1, strlen(text)) / 4096) AS BIGINT) AS blocks, sha256(text) AS content_hash, strlen(text) AS n_bytes, substr(text, 1, 64) AS head FROM documents")
def encrypted_block_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = blocks.store(table(spark, sf_dir, "documents"), blocks.DEMO_KEY, 4096)
    return blocks.verify(stored, blocks.DEMO_KEY)


@area.plan("SELECT doc_id, sha256(array_slice(encode(text), 501, 1300)) AS range_hash, CAST(greatest(0, least(strlen(text), 1300) - 500) AS BIGINT) AS n_bytes FROM documents WHERE strlen(text) > 256")
def archive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 500 to 1299 of every document that reaches their first block, from the blocks that hold them."""
    stored = blocks.store(table(spark, sf_dir, "documents"), blocks.DEMO_KEY, 256)
    part = blocks.read_range(stored, blocks.DEMO_KEY, 256, 500, 1299)
    return part.select("doc_id", F.sha2("body", 256).alias("range_hash"), F.octet_length("body").cast("long").alias("n_bytes"))
