"""Guards, state changes, sinks and small grammars, each as one statement over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import evidence, reduction
from loomstone.plans.shared import Catalogue
from loomstone.sources.tables import table

area = Catalogue()

area.sql(
    "page_truncation",
    "SELECT doc_id, sha2(substring(text, 1, 20000), 256) AS shown_hash, length(text) > 20000 AS truncated FROM {documents}",
    "SELECT doc_id, sha256(substr(text, 1, 20000)) AS shown_hash, length(text) > 20000 AS truncated FROM documents",
)
area.sql(
    "capacity_bounds",
    """
    SELECT source, lang, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(octet_length(text)) AS BIGINT) AS bytes,
           count(*) <= 100 AND sum(length(text)) <= 500000 AND sum(octet_length(text)) <= 2097152 AS within FROM {documents} GROUP BY source, lang""",
    """
    SELECT source, lang, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
           count(*) <= 100 AND sum(length(text)) <= 500000 AND sum(strlen(text)) <= 2097152 AS within FROM documents GROUP BY source, lang""",
)
area.sql(
    "index_inventory",
    """
    SELECT d.source, count(*) AS documents, count(l.doc_id) AS reviewed, count(CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 END) AS published, count(e.vec_id) AS embedded
    FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id GROUP BY d.source""",
)
area.sql(
    "quality_rounds",
    """
    SELECT lang, count(*) AS raw, count(l.doc_id) AS inspected, count(CASE WHEN l.quality = 1 THEN 1 END) AS accepted, count(CASE WHEN l.quality = 0 THEN 1 END) AS low_quality,
           count(CASE WHEN l.toxic = 1 THEN 1 END) AS toxic, count(*) - count(l.doc_id) AS missing
    FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY lang""",
)
area.sql(
    "outbox_status",
    """
    SELECT s.status, coalesce(c.n, 0) AS n, coalesce(c.newest, -1) AS newest
    FROM (VALUES ('view'), ('click'), ('purchase'), ('error'), ('signup'), ('expired')) AS s(status)
    LEFT JOIN (SELECT event_type, count(*) AS n, max(event_id) AS newest FROM {events} GROUP BY event_type) c ON c.event_type = s.status""",
)
area.sql(
    "evidence_bundles",
    """
    SELECT conv_id, count(*) AS parts FROM {conversations} GROUP BY conv_id
    HAVING min(CASE WHEN length(trim(text)) > 0 AND length(text) <= 4000 THEN 1 ELSE 0 END) = 1""",
)
area.sql(
    "turn_contiguity",
    "SELECT conv_id, count(*) AS turns, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM {conversations} GROUP BY conv_id",
)
area.sql(
    "activity_sessions",
    """
    SELECT user_id, session, count(*) AS hits FROM (
      SELECT user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM (
        SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM {events}) a) b
    GROUP BY user_id, session""",
)
area.sql(
    "staged_cutover",
    """
    SELECT d.source, count(*) AS active, count(e.vec_id) AS ready, count(*) = count(e.vec_id) AS cut_over
    FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id WHERE l.quality = 1 GROUP BY d.source""",
)
area.sql(
    "revision_bumps",
    """
    SELECT event_id, user_id, count(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS revision FROM {events}""",
)
area.sql(
    "duplicate_uploads",
    """
    SELECT d.doc_id, f.first_doc, d.doc_id > f.first_doc AS reused FROM {documents} d
    JOIN (SELECT source, sha2(text, 256) AS h, min(doc_id) AS first_doc FROM {documents} GROUP BY source, sha2(text, 256)) f ON f.source = d.source AND f.h = sha2(d.text, 256)""",
    """
    SELECT d.doc_id, f.first_doc, d.doc_id > f.first_doc AS reused FROM documents d
    JOIN (SELECT source, sha256(text) AS h, min(doc_id) AS first_doc FROM documents GROUP BY source, sha256(text)) f ON f.source = d.source AND f.h = sha256(d.text)""",
)
area.sql(
    "outbox_idempotency",
    """
    SELECT concat(event_type, ':', user_id) AS idempotency_key, min(event_id) AS event_id, count(*) - 1 AS repeats, count(DISTINCT props) > 1 AS mismatch
    FROM {events} GROUP BY event_type, user_id""",
)
area.sql(
    "stage_sequence",
    """
    SELECT conv_id, sum(CASE WHEN role = 'assistant' AND (before IS NULL OR before <> 'user') THEN 1 ELSE 0 END) AS out_of_order, count(*) AS stages FROM (
      SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}) t GROUP BY conv_id""",
    """
    SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' AND (before IS NULL OR before <> 'user') THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order, count(*) AS stages FROM (
      SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) t GROUP BY conv_id""",
)
area.sql(
    "insert_if_absent",
    """
    SELECT c_custkey AS principal, 'kept' AS outcome FROM {customer}
    UNION ALL
    SELECT DISTINCT s_suppkey + 1000 AS principal, 'inserted' AS outcome FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = s.s_suppkey + 1000)""",
)
area.sql(
    "status_rewrite",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND late THEN 'E' ELSE o_orderstatus END AS status FROM (
      SELECT o_orderkey, o_orderstatus, o_orderdate < (SELECT max(o_orderdate) - INTERVAL 1000 DAYS FROM {orders}) AS late FROM {orders}) t""",
)
area.sql(
    "filename_sanitize",
    r"""
    SELECT page_id, name, CASE WHEN name = '' THEN 'required' WHEN length(name) > 255 THEN 'too_long' ELSE 'accepted' END AS verdict FROM (
      SELECT page_id, regexp_replace(trim(element_at(split(replace(url, chr(92), '/'), '/'), -1)), '[\\x00-\\x1f]', '') AS name FROM {pages}) t""",
    r"""
    SELECT page_id, name, CASE WHEN name = '' THEN 'required' WHEN length(name) > 255 THEN 'too_long' ELSE 'accepted' END AS verdict FROM (
      SELECT page_id, regexp_replace(trim(string_split(replace(url, chr(92), '/'), '/')[-1]), '[\x00-\x1f]', '', 'g') AS name FROM pages) t""",
)
area.sql("principal_normalise", "SELECT c_custkey, lower(trim(concat(' ', c_name, ' '))) AS login FROM {customer}")
area.sql(
    "byte_ranges",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(split(substring(r, 7), '-')[0] AS BIGINT) AS first_byte, CAST(split(substring(r, 7), '-')[1] AS BIGINT) AS last_byte
    FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, concat('bytes=', l_partkey, '-', l_partkey + CAST(l_quantity AS BIGINT) * 1000) AS r FROM {lineitem}) t WHERE r RLIKE '^bytes=[0-9]+-[0-9]+$'""",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(regexp_extract(r, '^bytes=([0-9]+)-', 1) AS BIGINT) AS first_byte, CAST(regexp_extract(r, '-([0-9]+)$', 1) AS BIGINT) AS last_byte
    FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, concat('bytes=', l_partkey, '-', l_partkey + CAST(l_quantity AS BIGINT) * 1000) AS r FROM lineitem) t""",
)
area.sql(
    "reduce_calls",
    """
    SELECT source, n, CAST(aggregate(sequence(1, 20), named_struct('left', n, 'calls', 0L),
      (s, i) -> named_struct('left', CAST(ceil(s.left / 8) AS BIGINT), 'calls', s.calls + CASE WHEN s.left > 1 THEN s.left DIV 8 + CASE WHEN s.left % 8 > 1 THEN 1L ELSE 0L END ELSE 0L END)).calls AS BIGINT) AS calls
    FROM (SELECT source, count(*) AS n FROM {documents} GROUP BY source UNION ALL SELECT concat('line ', l_linenumber, l_returnflag), count(*) FROM {lineitem} GROUP BY l_linenumber, l_returnflag) t""",
    """
    WITH RECURSIVE g AS (SELECT source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT concat('line ', l_linenumber, l_returnflag), count(*) FROM lineitem GROUP BY l_linenumber, l_returnflag),
    t AS (
      SELECT source, n, n AS l, CAST(0 AS BIGINT) AS calls FROM g
      UNION ALL SELECT source, n, CAST(ceil(l / 8) AS BIGINT), calls + l // 8 + CASE WHEN l % 8 > 1 THEN 1 ELSE 0 END FROM t WHERE l > 1)
    SELECT source, n, CAST(max(calls) AS BIGINT) AS calls FROM t GROUP BY source, n""",
)
area.sql(
    "reduce_levels",
    """
    SELECT level, slot, count(*) AS members, sum(units) AS units FROM (
      SELECT 1 AS level, CAST(floor(doc_id / 8) AS BIGINT) AS slot, n_chars AS units FROM {documents}
      UNION ALL SELECT 2, CAST(floor(doc_id / 64) AS BIGINT), n_chars FROM {documents}) t GROUP BY level, slot""",
    """
    SELECT level, slot, count(*) AS members, CAST(sum(units) AS BIGINT) AS units FROM (
      SELECT 1 AS level, CAST(floor(doc_id / 8) AS BIGINT) AS slot, n_chars AS units FROM documents
      UNION ALL SELECT 2, CAST(floor(doc_id / 64) AS BIGINT), n_chars FROM documents) t GROUP BY level, slot""",
)
area.sql(
    "diverse_subset",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(place AS BIGINT) AS place FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY in_page, in_section, l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, page ORDER BY in_section, l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS in_page FROM (
          SELECT *, l_suppkey % 4 AS page, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4, l_returnflag ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS in_section FROM {lineitem}) a) b) c
    WHERE place <= 3""",
)
area.sql(
    "evaluation_rates",
    """
    SELECT lang, round(coalesce(avg(CASE WHEN l.quality = 1 THEN CAST(1 - l.toxic AS DOUBLE) END), 1.0), 6) AS supported_rate, round(coalesce(avg(CASE WHEN l.quality = 0 THEN CAST(l.toxic AS DOUBLE) END), 1.0), 6) AS abstention_rate, count(l.doc_id) AS cases
    FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY lang""",
)
area.sql(
    "threshold_gate",
    """
    SELECT m.name, m.value, CASE WHEN t.kind = 'min' THEN m.value >= t.bound ELSE m.value <= t.bound END AS passed FROM (
      SELECT 'errors' AS name, CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE) AS value FROM {events}
      UNION ALL SELECT 'mean_value', round(avg(value), 6) FROM {events}
      UNION ALL SELECT 'users', CAST(count(DISTINCT user_id) AS DOUBLE) FROM {events}) m
    JOIN (VALUES ('errors', 'max', 100.0), ('mean_value', 'min', 10.0), ('users', 'min', 50.0)) AS t(name, kind, bound) ON t.name = m.name""",
)
area.sql(
    "canonical_json",
    "SELECT p_partkey, sha2(to_json(named_struct('brand', p_brand, 'name', p_name, 'size', p_size)), 256) AS fingerprint FROM {part}",
    "SELECT p_partkey, sha256(CAST(json_object('brand', p_brand, 'name', p_name, 'size', p_size) AS VARCHAR)) AS fingerprint FROM part",
)
area.sql(
    "vector_validation",
    """
    SELECT vec_id, size(embedding) = 64 AND forall(embedding, x -> NOT isnan(x) AND abs(x) < 1e30) AND exists(embedding, x -> x <> 0) AS valid,
           round(sqrt(aggregate(embedding, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * x)), 5) AS length FROM {embeddings}""",
    """
    SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR abs(x) >= 1e30)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid,
           round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS length FROM embeddings""",
)
area.sql(
    "elapsed_ms",
    """
    SELECT event_id, coalesce(greatest(0L, (unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS TIMESTAMP))) DIV 1000), 0L) AS elapsed FROM {events}
    WHERE user_id IS NOT NULL""",
    """
    SELECT event_id, CAST(coalesce(greatest(0, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000), 0) AS BIGINT) AS elapsed FROM events
    WHERE user_id IS NOT NULL""",
)
#: A stemmed word, an acronym, and what may stand for it.
_STEMMED = "[a-z][a-z0-9-]*"
_ACRONYM = "[A-Z][A-Z0-9]{1,11}(?:-[A-Z0-9]{2,11})*"
_EXPANSION = r"[A-Z][A-Za-z-]+(?:[ \t]+[A-Za-z][A-Za-z-]+){0,8}"


def _doc_words(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))


@area.plan(f"""
    SELECT doc_id, coalesce(array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '{tx.NAVIGATION_WORD}')), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in tx.NAVIGATION_STOP)}))), ' '), '') AS terms
    FROM documents""")
def navigation_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tx.navigation_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(kept), " ").alias("terms"))


@area.plan(f"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_STEMMED}')) AS w FROM documents),
    s AS (
      SELECT doc_id, w FROM w
      UNION SELECT doc_id, left(w, length(w) - 3) FROM w WHERE length(w) > 5 AND w LIKE '%ing'
      UNION SELECT doc_id, left(w, length(w) - 3) || 'y' FROM w WHERE length(w) > 4 AND w LIKE '%ies'
      UNION SELECT doc_id, left(w, length(w) - 1) FROM w WHERE length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' AND NOT (length(w) > 4 AND w LIKE '%ies'))
    SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY w), '') AS stems FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id""")
def light_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    stem = lambda w: (
        F.when((F.length(w) > 5) & w.endswith("ing"), cut(w, 3))
        .when((F.length(w) > 4) & w.endswith("ies"), F.concat(cut(w, 3), F.lit("y")))
        .when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), cut(w, 1))
        .otherwise(w)
    )
    both = F.array_union("words", F.transform("words", stem))
    return _doc_words(spark, sf_dir, _STEMMED).select("doc_id", F.array_join(F.array_sort(both), " ").alias("stems"))


_MENTIONS = """
    SELECT p_brand AS page, string_agg(CASE WHEN p_size % 2 = 0 THEN long || ' (' || short || ')' ELSE short || ' (' || long || ')' END, '. ' ORDER BY p_partkey) AS text FROM (
      SELECT p_brand, p_partkey, p_size, upper(left(p_name, 1)) || substr(p_name, 2) AS long, upper(left(p_name, 2)) || CASE WHEN p_size > 25 THEN '-' || p_partkey % 90 + 10 ELSE '' END AS short FROM part) GROUP BY p_brand"""


@area.plan(rf"""
    WITH p AS (
      SELECT page, unnest(list_zip(regexp_extract_all(text, '({_ACRONYM})\s*\(({_EXPANSION})\)', 1), regexp_extract_all(text, '({_ACRONYM})\s*\(({_EXPANSION})\)', 2))) AS m FROM ({_MENTIONS})
      UNION ALL
      SELECT page, unnest(list_zip(regexp_extract_all(text, '({_EXPANSION})\s*\(({_ACRONYM})\)', 2), regexp_extract_all(text, '({_EXPANSION})\s*\(({_ACRONYM})\)', 1))) FROM ({_MENTIONS}))
    SELECT page, short, max(lower(long)) AS long, count(*) AS mentions FROM (SELECT page, m[1] AS short, m[2] AS long FROM p) GROUP BY page, short HAVING count(DISTINCT lower(long)) = 1""")
def acronym_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of the names of a brand's parts and their short forms; a short form of several names is left out."""
    part = table(spark, sf_dir, "part")
    short = F.concat(F.upper(F.left("p_name", F.lit(2))), F.when(F.col("p_size") > 25, F.concat(F.lit("-"), (F.col("p_partkey") % 90 + 10).cast("string"))).otherwise(""))
    name = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000))
    said = F.when(F.col("p_size") % 2 == 0, F.concat(name, F.lit(" ("), short, F.lit(")"))).otherwise(F.concat(short, F.lit(" ("), name, F.lit(")")))
    # no pair runs over the end of a sentence, so each part is read for itself and the pairs meet by page
    return evidence.aliases(part.select(F.col("p_brand").alias("page"), said.alias("text")), _ACRONYM, _EXPANSION)


@area.plan(r"""
    SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (
      SELECT conv_id, turn, n, greatest(1, CAST(ceil((sum(length(item)) OVER w + 5 * n) / 3) AS BIGINT), CAST(ceil((sum(strlen(item)) OVER w + 5 * n) / 4) AS BIGINT), sum(units) OVER w + n + 1) AS used FROM (
        SELECT conv_id, turn, item, len(regexp_extract_all(item, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS units, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (
          SELECT conv_id, turn, CAST(json_object('question', substr(text, 1, 160), 'answer', substr(reply, 1, 96)) AS VARCHAR) AS item FROM (
            SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) c
          WHERE role = 'user' AND next_role = 'assistant' AND text IS NOT NULL AND reply IS NOT NULL) i) m
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t WHERE n <= 32 AND used <= 384""")
def exclusions_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question and answer pairs of a conversation whose JSON list, in order, stays within the estimate."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ahead = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("reply"), F.lead("role").over(w).alias("by"))
    pairs = ahead.where("role = 'user' AND by = 'assistant' AND text IS NOT NULL AND reply IS NOT NULL")
    item = F.to_json(F.struct(F.substring("text", 1, 160).alias("question"), F.substring("reply", 1, 96).alias("answer")))
    sized = pairs.select("conv_id", "turn", item.alias("item")).select("conv_id", "turn", F.length("item").alias("chars"), F.octet_length("item").alias("bytes"), F.regexp_count("item", F.lit(tx.UNIT)).alias("units"))
    n, run = F.row_number().over(w).cast("long"), w.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(run)
    # three blanks inside each pair, a comma and a blank between pairs, two brackets around
    used = F.greatest(F.lit(1).cast("long"), F.ceil((total("chars") + 5 * n) / 3), F.ceil((total("bytes") + 5 * n) / 4), total("units") + n + 1)
    return sized.select("conv_id", "turn", used.alias("used"), n.alias("n")).where("n <= 32 AND used <= 384").drop("n")


_JOIN = "sha256(array_to_string(list(v ORDER BY n), '|'))"
_LEVEL = "{up} AS (SELECT source, n // 8 AS n, CASE WHEN count(*) = 1 THEN any_value(v) ELSE " + _JOIN + " END AS v, sum(parts) AS parts FROM {down} GROUP BY source, n // 8)"


@area.plan(
    "WITH l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, CAST(doc_id AS VARCHAR) AS v, 1 AS parts FROM documents), "
    + ", ".join(_LEVEL.format(up=f"l{k + 1}", down=f"l{k}") for k in range(8))
    + " SELECT source, v AS summary, CAST(parts AS BIGINT) AS parts FROM l8"
)
def summary_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every source, in the order of their ids, combined by eights until one is left."""
    parts = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("summary"))
    return reduction.reduce_levels(parts, ["source"], "doc_id", "summary", lambda values: F.sha2(F.array_join(values, "|"), 256))
