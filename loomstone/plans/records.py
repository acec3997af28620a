"""Sinks, table rules, queues, sessions and counters: orders, lines and events stand for jobs, cards and requests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import admission
from loomstone.plans.shared import Catalogue
from loomstone.sources import blocks, folders
from loomstone.sources.tables import table
from loomstone.streaming import learner

area = Catalogue()

# sources
area.sql(
    "ordinal_ids",
    """
    SELECT l_orderkey, CAST(pos + 1 AS BIGINT) AS ordinal, id, p_name FROM (
      SELECT l_orderkey, posexplode(transform(sort_array(collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice))), x -> x.l_partkey)) AS (pos, id) FROM {lineitem} GROUP BY l_orderkey) t
    JOIN {part} p ON p.p_partkey = t.id""",
    """
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal, l_partkey AS id, p_name
    FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
area.sql(
    "media_check",
    """
    SELECT page_id, CASE WHEN html IS NULL THEN 'missing' WHEN NOT startswith(lower(html), '<!doctype html') THEN 'wrong_signature' WHEN octet_length(html) > 8192 THEN 'too_large' ELSE 'accepted' END AS verdict FROM {pages}""",
    """
    SELECT page_id, CASE WHEN html IS NULL THEN 'missing' WHEN NOT starts_with(lower(html), '<!doctype html') THEN 'wrong_signature' WHEN strlen(html) > 8192 THEN 'too_large' ELSE 'accepted' END AS verdict FROM pages""",
)


@area.plan("SELECT item_id, sha256(text) AS content_hash FROM benchmark")
def json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as JSON files of one list each, written over several lines and read back so."""
    folder = folders.shared(spark, "corpus")
    items = table(spark, sf_dir, "benchmark")
    shelf = F.floor(F.col("item_id") / 256).alias("shelf")  # at most 256 items a file
    listed = items.groupBy(shelf).agg(F.to_json(F.collect_list(F.struct("item_id", "text")), {"pretty": "true"}).alias("value"))
    listed.write.partitionBy("shelf").text(folder)
    read = spark.read.schema("item_id long, text string, shelf long").option("multiLine", True).json(folder)
    return read.select("item_id", F.sha2("text", 256).alias("content_hash"))


@area.plan("SELECT doc_id, least(4, len(string_split(text, chr(10)))) AS cards, TRUE AS complete FROM documents WHERE text IS NOT NULL")
def staged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a document, sealed as one JSON list under its identity and counted again when opened."""
    cards = F.transform(F.slice(F.split("text", "\n"), 1, 4), lambda x: F.struct(x.alias("front")))
    name = F.concat(F.lit("stage:"), F.col("doc_id").cast("string"))
    body = F.encode(F.to_json(cards), "utf-8")
    nonce = F.substring(F.unhex(F.sha2(F.concat(F.encode(name, "utf-8"), body), 256)), 1, 12)
    sealed = F.aes_encrypt(body, F.lit(blocks.DEMO_KEY), F.lit("GCM"), F.lit("DEFAULT"), nonce, name)
    staged = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(cards).cast("long").alias("cards"), sealed.alias("sealed"))
    opened = F.decode(F.try_aes_decrypt("sealed", F.lit(blocks.DEMO_KEY), F.lit("GCM"), F.lit("DEFAULT"), name), "utf-8")
    return staged.select("doc_id", "cards", (F.size(F.from_json(opened, "array<struct<front: string>>")) == F.col("cards")).alias("complete"))


# sinks
@area.plan("SELECT o_orderstatus AS status, count(*) AS rows_read FROM orders GROUP BY o_orderstatus")
def bulk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, orders = folders.shared(spark, "appended"), table(spark, sf_dir, "orders")
    for batch in (orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus <> 'O'")):
        batch.write.mode("append").parquet(folder)
    return spark.read.schema(orders.schema).parquet(folder).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("rows_read"))


area.sql(
    "validated_insert",
    """
    SELECT l_orderkey, count(*) AS offered, sum(CASE WHEN l_quantity BETWEEN 1 AND 49 AND l_discount <= 0.09 THEN 0 ELSE 1 END) AS bad,
           CASE WHEN sum(CASE WHEN l_quantity BETWEEN 1 AND 49 AND l_discount <= 0.09 THEN 0 ELSE 1 END) = 0 THEN count(*) ELSE 0 END AS inserted
    FROM {lineitem} GROUP BY l_orderkey""",
    """
    SELECT l_orderkey, count(*) AS offered, count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 49 AND l_discount <= 0.09)) AS bad,
           CASE WHEN count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 49 AND l_discount <= 0.09)) = 0 THEN count(*) ELSE 0 END AS inserted
    FROM lineitem GROUP BY l_orderkey""",
)


@area.plan("SELECT c_custkey, c_name, TRUE AS second_refused FROM customer")
def exclusive_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export that must not overwrite: the second writer of the same path is refused."""
    folder, profile = folders.shared(spark, "export"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    profile.write.mode("errorifexists").json(folder)
    try:
        profile.limit(0).write.mode("errorifexists").json(folder)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.schema(profile.schema).json(folder).withColumn("second_refused", F.lit(refused))


@area.plan("SELECT event_type, count(*) AS appended FROM events GROUP BY event_type")
def request_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests appended by a stream."""
    stream = learner.event_stream(spark, sf_dir).select("event_id", "event_type")
    return learner.drain(stream, "append", folders.shared(spark, "stream")).groupBy("event_type").agg(F.count("*").alias("appended"))


@area.plan("SELECT event_id AS audit_id, user_id AS actor, CASE event_type WHEN 'signup' THEN 'account.create' ELSE 'account.charge' END AS action, md5(props) AS target FROM events WHERE event_type IN ('signup', 'purchase')")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Privileged events in fixed fields; the trail is only appended to."""
    folder, events = folders.shared(spark, "audit"), table(spark, sf_dir, "events")
    for kind, action in (("signup", "account.create"), ("purchase", "account.charge")):
        rows = events.where(F.col("event_type") == kind)
        rows.select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("actor"), F.lit(action).alias("action"), F.md5("props").alias("target")).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


# projections and predicates
area.sql("study_cards", "SELECT p_partkey AS card, p_name AS front, p_size AS ordinal FROM {part}")
area.sql(
    "visible_cards",
    """
    SELECT 'owner' AS role, source, count(*) AS cards FROM {documents} GROUP BY source
    UNION ALL
    SELECT 'student', d.source, count(*) FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND l.toxic = 0 GROUP BY d.source""",
)
area.sql(
    "snapshot_fence",
    """
    SELECT d.doc_id, d.source, p.revision FROM {documents} d
    JOIN (SELECT source, count(*) AS revision FROM {documents} GROUP BY source) c ON c.source = d.source
    JOIN (SELECT d.source, count(*) AS revision FROM {documents} d JOIN {embeddings} e ON e.vec_id = d.doc_id GROUP BY d.source) p ON p.source = d.source AND p.revision * 2 >= c.revision""",
)
area.sql(
    "optional_filter",
    """
    SELECT scope, lang, count(*) AS chunks FROM (
      SELECT 'all' AS scope, lang FROM {documents}
      UNION ALL SELECT 'selected', lang FROM {documents} WHERE doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 1)) t GROUP BY scope, lang""",
)
area.sql(
    "changed_fields",
    """
    SELECT event_id, event_type IS DISTINCT FROM old_type AS type_changed, value IS DISTINCT FROM old_value AS value_changed FROM (
      SELECT event_id, event_type, value, lag(event_type) OVER w AS old_type, lag(value) OVER w AS old_value FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) t""",
)
area.sql(
    "table_rules",
    """
    SELECT l_linestatus, count(*) AS n, count(CASE WHEN NOT coalesce(l_quantity BETWEEN 1 AND 50, false) THEN 1 END) AS quantity_range, count(CASE WHEN NOT coalesce(l_discount BETWEEN 0 AND 0.08, false) THEN 1 END) AS discount_range,
           count(CASE WHEN NOT coalesce(l_returnflag IN ('A', 'N'), false) THEN 1 END) AS flag_enum, count(CASE WHEN (l_returnflag = 'R') <> (l_tax > 0.04) THEN 1 END) AS pair_shape, count(CASE WHEN length(l_returnflag) <> 1 THEN 1 END) AS flag_length
    FROM {lineitem} GROUP BY l_linestatus""",
)
area.sql(
    "evidence_guard",
    """
    SELECT j.event_id, j.running AND j.retry_matches AND NOT j.expired AND d.doc_id IS NOT NULL AND coalesce(j.first_char + 40 <= length(d.text), false) AS valid,
           CASE WHEN NOT j.running THEN 'not_running' WHEN NOT j.retry_matches THEN 'stale_retry' WHEN j.expired THEN 'expired' WHEN d.doc_id IS NULL THEN 'out_of_scope' WHEN j.first_char + 40 > length(d.text) THEN 'bad_offsets' END AS reason
    FROM (SELECT event_id, user_id, event_type <> 'error' AS running, value < 90 AS retry_matches, event_type = 'signup' AND value < 5 AS expired, CAST(floor(value * 20) AS INT) AS first_char FROM {events}) j
    LEFT JOIN {documents} d ON d.doc_id = j.user_id""",
)
area.sql(
    "allow_list_scrub",
    """
    SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unclassified' END AS code, CASE WHEN floor(value) BETWEEN 1 AND 20 THEN CAST(floor(value) AS BIGINT) END AS rank FROM {events}""",
)
area.sql("sole_row", "SELECT p_name, p_size, count(*) = 1 AS sole, min(p_partkey) AS first_key FROM {part} GROUP BY p_name, p_size")

# joins
area.sql(
    "canonical_pages",
    """
    SELECT a.l_orderkey, a.l_linenumber, c.p_name, a.l_quantity FROM {lineitem} a
    JOIN (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, p_name FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_size > 10 GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, p_name) c
      ON c.l_orderkey = a.l_orderkey AND c.l_partkey = a.l_partkey AND c.l_suppkey = a.l_suppkey AND c.l_linenumber = a.l_linenumber AND c.l_returnflag = a.l_returnflag""",
)
#: Lines that a partition of a wide shuffle has at most, about.
SPREAD = 500_000


def _spread(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """Dealt by the key to so many partitions if a shuffle would have fewer, so that a task holds no more of a larger table."""
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


@area.plan("""
    SELECT r.r_name, p.p_brand, count(*) AS cited, count(DISTINCT o.o_orderkey) AS jobs
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size >= l.l_linenumber GROUP BY r.r_name, p.p_brand""")
def historical_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and orders of every region and brand; lines and orders meet and are counted in partitions whose number grows with them."""
    lineitem, orders, part, customer, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer", "nation", "region"))
    parts = -(-lineitem.count() // SPREAD)
    cited = _spread(lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), "l_partkey", parts).join(_spread(part, "p_partkey", parts), (F.col("p_partkey") == F.col("l_partkey")) & (F.col("p_size") >= F.col("l_linenumber")))
    placed = _spread(orders.select("o_orderkey", "o_custkey"), "o_custkey", parts).join(_spread(customer, "c_custkey", parts), F.col("c_custkey") == F.col("o_custkey"))
    placed = placed.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    cited, placed = _spread(cited.select("l_orderkey", "p_brand"), "l_orderkey", parts), _spread(placed.select("o_orderkey", "r_name"), "o_orderkey", parts)
    met = cited.join(placed, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("r_name", "p_brand", "o_orderkey").agg(F.count("*").alias("n"))
    return met.groupBy("r_name", "p_brand").agg(F.sum("n").alias("cited"), F.count("o_orderkey").alias("jobs"))


area.sql(
    "prefetched_children",
    """
    SELECT o.o_orderkey, coalesce(size(k.kids), 0) AS children, coalesce(array_join(transform(k.kids, x -> concat(x.l_linenumber, ':', x.l_partkey)), ','), '') AS listed
    FROM {orders} o LEFT JOIN (SELECT l_orderkey, sort_array(collect_list(struct(l_linenumber, l_partkey))) AS kids FROM {lineitem} GROUP BY l_orderkey) k ON k.l_orderkey = o.o_orderkey""",
    """
    SELECT o_orderkey, CAST(coalesce(n, 0) AS INT) AS children, coalesce(listed, '') AS listed
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS listed FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)

# aggregates
area.sql("next_sequence", "SELECT c.c_custkey, coalesce(max(o.o_orderkey), 0) + 1 AS next_no, count(o.o_orderkey) AS revisions FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
area.sql(
    "retained_bytes",
    "SELECT d.source, count(*) AS kept, CAST(sum(octet_length(d.text)) AS BIGINT) AS bytes FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.toxic = 0 GROUP BY d.source",
    "SELECT d.source, count(*) AS kept, CAST(sum(strlen(d.text)) AS BIGINT) AS bytes FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 0 GROUP BY d.source",
)
#: Daily limits of a user and of all users, in the order in which they are asked.
DAILY = (
    ("user", "jobs", 4, "user_daily_jobs"), ("user", "units", 150, "user_daily_units"), ("user", "bytes", 30, "user_daily_bytes"),
    ("all", "jobs", 240, "daily_jobs"), ("all", "units", 9000, "daily_units"), ("all", "bytes", 2100, "daily_bytes"),
)
_CHARGED = "SELECT event_id, user_id, ts, date_trunc('day', ts) AS day, 1 AS jobs, CAST(floor(value) AS BIGINT) AS units, length(props) AS bytes FROM "


def _carry(limits, room: dict[str, str], verdict: str = "verdict") -> str:
    """CASE of the first limit that the carried totals leave no room for."""
    return "CASE " + " ".join(f"WHEN {room[s]}.{c} + e.{c} > {most} THEN '{code}'" for s, c, most, code in limits) + f" ELSE 'admitted' END AS {verdict}"


@area.plan(f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS n FROM ({_CHARGED} events)),
    step(day, n, event_id, verdict, users, total) AS (
      SELECT DISTINCT day, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(MAP {{}} AS MAP(BIGINT, STRUCT(jobs BIGINT, units BIGINT, bytes BIGINT))), {{'jobs': 0::BIGINT, 'units': 0::BIGINT, 'bytes': 0::BIGINT}} FROM e
      UNION ALL
      SELECT day, n, event_id, verdict,
             CASE WHEN verdict = 'admitted' THEN map_concat(users, MAP {{user_id: {{'jobs': u.jobs + jobs, 'units': u.units + units, 'bytes': u.bytes + bytes}}}}) ELSE users END,
             CASE WHEN verdict = 'admitted' THEN {{'jobs': total.jobs + jobs, 'units': total.units + units, 'bytes': total.bytes + bytes}} ELSE total END
      FROM (SELECT e.*, s.users, s.total, s.u, {_carry(DAILY, {"user": "s.u", "all": "s.total"})} FROM (
              SELECT step.*, e.user_id AS who, coalesce(step.users[e.user_id], {{'jobs': 0::BIGINT, 'units': 0::BIGINT, 'bytes': 0::BIGINT}}) AS u FROM step JOIN e ON e.day = step.day AND e.n = step.n + 1) s
            JOIN e ON e.day = s.day AND e.n = s.n + 1))
    SELECT event_id, verdict FROM step WHERE n > 0""")
def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks for a job, units and bytes of its user's day and of everyone's; only what is admitted is charged."""
    asked = spark.sql(_CHARGED + "{events}", events=table(spark, sf_dir, "events"))
    scopes = {"user": ["day", "user_id"], "all": ["day"]}
    return admission.admit(asked, ["ts", "event_id"], scopes, ["jobs", "units", "bytes"], DAILY).select("event_id", "verdict")


#: Byte limits of a subject, an owner and the whole archive.
ARCHIVE = (("subject", "bytes", 150_000, "subject_capacity"), ("owner", "bytes", 500_000, "owner_capacity"), ("all", "bytes", 1_800_000, "archive_capacity"))
_ARCHIVED = "SELECT doc_id, source, lang, sha2(text, 256) AS file, octet_length(text) AS bytes FROM "


@area.plan(f"""
    WITH RECURSIVE e AS (SELECT doc_id, source, lang, sha256(text) AS file, CAST(strlen(text) AS BIGINT) AS bytes, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
    step(n, doc_id, verdict, subjects, owners, total, files) AS (
      SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)), CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)), CAST(0 AS BIGINT), CAST(MAP {{}} AS MAP(VARCHAR, BIGINT))
      UNION ALL
      SELECT n, doc_id, verdict, CASE WHEN verdict = 'admitted' THEN map_concat(subjects, MAP {{source: s + bytes}}) ELSE subjects END,
             CASE WHEN verdict = 'admitted' THEN map_concat(owners, MAP {{lang: o + bytes}}) ELSE owners END,
             CASE WHEN verdict = 'admitted' THEN total + bytes ELSE total END, CASE WHEN verdict = 'admitted' THEN map_concat(files, MAP {{file: n}}) ELSE files END
      FROM (SELECT *, CASE WHEN files[file] IS NOT NULL THEN 'attached' WHEN s + bytes > 150000 THEN 'subject_capacity' WHEN o + bytes > 500000 THEN 'owner_capacity' WHEN total + bytes > 1800000 THEN 'archive_capacity' ELSE 'admitted' END AS verdict
            FROM (SELECT e.*, subjects, owners, total, files, coalesce(subjects[source], 0) AS s, coalesce(owners[lang], 0) AS o FROM step JOIN e ON e.n = step.n + 1)))
    SELECT doc_id, verdict FROM step WHERE n > 0""")
def archive_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their ids against three byte quotas; a file that is archived already costs nothing."""
    asked = spark.sql(_ARCHIVED + "{documents}", documents=table(spark, sf_dir, "documents"))
    scopes = {"subject": ["source"], "owner": ["lang"], "all": []}
    return admission.admit(asked, ["doc_id"], scopes, ["bytes"], ARCHIVE, key="file").select("doc_id", "verdict")


area.sql(
    "nearest_rank_p95",
    "SELECT user_id, event_type, count(*) AS n, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM {events} GROUP BY user_id, event_type",
    """
    SELECT user_id, event_type, n, value AS p95 FROM (
      SELECT user_id, event_type, value, count(*) OVER (PARTITION BY user_id, event_type) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value) AS k FROM events)
    WHERE k = greatest(1, CAST(floor(n * 0.95 + 0.999999) AS BIGINT))""",
)
area.sql(
    "usage_fold",
    "SELECT user_id, CAST(sum(floor(value)) AS BIGINT) AS input_units, CAST(sum(floor(value * 2)) AS BIGINT) AS output_units, bool_or(event_type = 'error' AND value > 95) AS estimated FROM {events} GROUP BY user_id",
)
area.sql(
    "usage_counters",
    """
    SELECT CASE WHEN g = 0 THEN 'owner' WHEN g = 1 THEN 'group' ELSE 'all' END AS scope, n_nationkey, c_custkey, rows_held, cents FROM (
      SELECT n_nationkey, c_custkey, CAST(grouping(n_nationkey) + grouping(c_custkey) AS INT) AS g, count(o_orderkey) AS rows_held, CAST(sum(CAST(round(coalesce(o_totalprice, 0) * 100) AS BIGINT)) AS BIGINT) AS cents
      FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY GROUPING SETS ((n_nationkey, c_custkey), (n_nationkey), ())) t""",
)
area.sql(
    "bytes_by_union",
    """
    SELECT source, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
      SELECT source, octet_length(text) AS bytes FROM {documents}
      UNION ALL SELECT d.source, size(e.embedding) * 4 FROM {embeddings} e JOIN {documents} d ON d.doc_id = e.vec_id) t GROUP BY source""",
    """
    SELECT source, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
      SELECT source, strlen(text) AS bytes FROM documents
      UNION ALL SELECT d.source, len(e.embedding) * 4 FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) t GROUP BY source""",
)
area.sql(
    "rejection_histogram",
    """
    SELECT lang, count(*) AS raw, count(CASE WHEN reason IS NULL THEN 1 END) AS accepted, count(CASE WHEN reason = 'unlabelled' THEN 1 END) AS unlabelled, count(CASE WHEN reason = 'toxic' THEN 1 END) AS toxic,
           count(CASE WHEN reason = 'low_quality' THEN 1 END) AS low_quality, count(CASE WHEN reason = 'too_short' THEN 1 END) AS too_short, greatest(0, 100 - count(CASE WHEN reason IS NULL THEN 1 END)) AS missing
    FROM (SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low_quality' WHEN n_chars < 200 THEN 'too_short' END AS reason
          FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) t GROUP BY lang""",
)
area.sql(
    "run_summary",
    """
    SELECT d.source, count(*) AS cases, count(CASE WHEN l.quality = 1 THEN 1 END) AS accepted, count(DISTINCT CASE WHEN l.quality = 1 THEN d.lang END) AS distinct_pages, CAST(max(d.n_chars) AS BIGINT) AS largest
    FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.source""",
)
area.sql(
    "conversation_counters",
    """
    SELECT max(users) AS max_history, max(calls) AS max_calls, CAST(sum(forbidden) AS BIGINT) AS forbidden, round(sum(repeats) / sum(turns), 6) AS duplicate_rate FROM (
      SELECT conv_id, count(*) AS turns, count(CASE WHEN role = 'user' THEN 1 END) AS users, count(CASE WHEN role = 'assistant' THEN 1 END) AS calls, count(CASE WHEN role = 'system' THEN 1 END) AS forbidden, count(*) - count(DISTINCT text) AS repeats
      FROM {conversations} GROUP BY conv_id) t""",
)

# order and arrays
area.sql(
    "queue_head",
    "SELECT o_orderpriority AS queue, head.o_orderkey AS job FROM (SELECT o_orderpriority, min(struct(o_orderdate, o_orderkey)) AS head FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_orderpriority) t",
    "SELECT o_orderpriority AS queue, o_orderkey AS job FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1",
)
area.sql(
    "overflow_probe",
    "SELECT c_nationkey, least(count(*), 50) AS shown, count(*) > 50 AS more FROM (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM {customer}) t WHERE n <= 51 GROUP BY c_nationkey",
)
area.sql(
    "useful_first",
    """
    SELECT o_custkey, o_orderkey, CAST(place AS BIGINT) AS place FROM (
      SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS place FROM {orders}) t WHERE place <= 3""",
)
area.sql(
    "option_index",
    "SELECT p_partkey, CAST(array_position(transform(array(p_type, p_name, concat(' ', p_brand), CAST(p_size AS STRING)), x -> lower(trim(x))), lower(p_brand)) - 1 AS INT) AS position FROM {part}",
    "SELECT p_partkey, CAST(list_position(list_transform([p_type, p_name, concat(' ', p_brand), CAST(p_size AS VARCHAR)], lambda x: lower(trim(x))), lower(p_brand)) - 1 AS INT) AS position FROM part",
)

# state
area.sql(
    "rate_policies",
    """
    SELECT e.user_id, p.scope, e.slot, e.hits, e.hits > p.most AS limited FROM (
      SELECT user_id, event_type, CAST(floor(unix_timestamp(CAST(ts AS TIMESTAMP)) / 3600) AS BIGINT) AS slot, count(*) AS hits FROM {events} GROUP BY user_id, event_type, CAST(floor(unix_timestamp(CAST(ts AS TIMESTAMP)) / 3600) AS BIGINT)) e
    JOIN (VALUES ('view', 'login', 10), ('signup', 'registration', 1), ('click', 'refresh', 30), ('purchase', 'upload', 2), ('error', 'reset', 1)) AS p(kind, scope, most) ON p.kind = e.event_type""",
    """
    SELECT e.user_id, p.scope, e.slot, e.hits, e.hits > p.most AS limited FROM (
      SELECT user_id, event_type, CAST(floor(floor(epoch(ts)) / 3600) AS BIGINT) AS slot, count(*) AS hits FROM events GROUP BY ALL) e
    JOIN (VALUES ('view', 'login', 10), ('signup', 'registration', 1), ('click', 'refresh', 30), ('purchase', 'upload', 2), ('error', 'reset', 1)) AS p(kind, scope, most) ON p.kind = e.event_type""",
)
area.sql(
    "refresh_families",
    """
    SELECT event_id, user_id, family, CASE WHEN family = 0 THEN 'unknown' WHEN reused > 0 THEN 'revoked' WHEN ts > started + INTERVAL 5 DAYS THEN 'expired' ELSE 'active' END AS state FROM (
      SELECT event_id, user_id, ts, family, min(ts) OVER f AS started, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER f AS reused FROM (
        SELECT event_id, user_id, event_type, ts, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS family FROM {events}) a
      WINDOW f AS (PARTITION BY user_id, family ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) b""",
)
area.sql(
    "queue_claims",
    """
    SELECT user_id AS queue, event_id AS job, attempts + 1 AS attempt, sha2(concat(user_id, ':', event_id, ':', attempts + 1), 256) AS token FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CAST(floor(value / 40) AS BIGINT) AS attempts FROM {events} WHERE event_type IN ('signup', 'purchase')) t
    WHERE n = 1""",
    """
    SELECT user_id AS queue, event_id AS job, attempts + 1 AS attempt, sha256(concat(user_id, ':', event_id, ':', attempts + 1)) AS token FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CAST(floor(value / 40) AS BIGINT) AS attempts FROM events WHERE event_type IN ('signup', 'purchase')) t
    WHERE n = 1""",
)
area.sql(
    "lease_extension",
    """
    SELECT user_id, beats, least(last_beat + INTERVAL 15 MINUTES, started + INTERVAL 10 DAYS) AS lease_expires, last_beat + INTERVAL 15 MINUTES > started + INTERVAL 10 DAYS AS at_deadline
    FROM (SELECT user_id, count(*) AS beats, min(ts) AS started, max(ts) AS last_beat FROM {events} WHERE event_type IN ('view', 'click') GROUP BY user_id) t""",
)
area.sql(
    "token_fencing",
    """
    SELECT event_id, claim, CASE WHEN claim IS NULL THEN 'unclaimed' WHEN ts > claimed + INTERVAL 2 DAYS THEN 'lease_expired' WHEN other > claim THEN 'wrong_token' ELSE 'accepted' END AS verdict FROM (
      SELECT event_id, event_type, ts, last_value(CASE WHEN event_type = 'signup' THEN event_id END) IGNORE NULLS OVER w AS claim, last_value(CASE WHEN event_type = 'signup' THEN ts END) IGNORE NULLS OVER w AS claimed,
             last_value(CASE WHEN event_type = 'error' THEN event_id END) IGNORE NULLS OVER w AS other
      FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t WHERE event_type = 'purchase'""",
    """
    SELECT event_id, claim, CASE WHEN claim IS NULL THEN 'unclaimed' WHEN ts > claimed + INTERVAL 2 DAYS THEN 'lease_expired' WHEN other > claim THEN 'wrong_token' ELSE 'accepted' END AS verdict FROM (
      SELECT event_id, event_type, ts, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS claim, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER w AS claimed,
             last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS other
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t WHERE event_type = 'purchase'""",
)
