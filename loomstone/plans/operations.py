"""Operational aggregates: counts, usage, quotas, queues, retention, guards and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.operators import ops
from loomstone.plans.shared import Catalogue
from loomstone.sources.tables import table

area = Catalogue()

area.sql("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY o_orderstatus")
area.sql(
    "route_counts",
    "SELECT event_type, CAST(user_id % 10 AS INT) AS shard, count(*) AS n FROM {events} GROUP BY event_type, CAST(user_id % 10 AS INT) ORDER BY event_type, shard LIMIT 1000",
)
area.sql(
    "missing_source_jobs",
    "SELECT o_orderkey, o_orderstatus FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)",
)
area.sql(
    "entity_counters",
    """
    SELECT n.n_nationkey, n.n_name, coalesce(c.customers, 0) AS customers, coalesce(c.funded, 0) AS funded, coalesce(s.suppliers, 0) AS suppliers
    FROM {nation} n
    LEFT JOIN (SELECT c_nationkey, count(*) AS customers, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS funded FROM {customer} GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM {supplier} GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey""",
    """
    SELECT n.n_nationkey, n.n_name, coalesce(c.customers, 0) AS customers, CAST(coalesce(c.funded, 0) AS BIGINT) AS funded, coalesce(s.suppliers, 0) AS suppliers
    FROM nation n
    LEFT JOIN (SELECT c_nationkey, count(*) AS customers, count(*) FILTER (c_acctbal > 0) AS funded FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey""",
)
area.sql(
    "authorized_scope",
    """
    SELECT n.n_nationkey AS scope, p.role, count(*) AS principals
    FROM {nation} n JOIN (
      SELECT s_nationkey AS nationkey, 'owner' AS role FROM {supplier}
      UNION ALL
      SELECT c_nationkey, 'enrolled' FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)) p ON p.nationkey = n.n_nationkey
    GROUP BY n.n_nationkey, p.role""",
)
area.sql(
    "worker_health",
    """
    SELECT user_id, event_type AS status, CAST(seen AS STRING) AS last_seen,
           event_type IN ('view', 'click') AND seen > TIMESTAMP_NTZ '2024-01-01 00:00:00' AS healthy
    FROM (SELECT user_id, event_type, ts AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {events})
    WHERE n = 1 ORDER BY seen DESC, user_id LIMIT 100""",
    """
    SELECT user_id, event_type AS status, strftime(seen, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(seen) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(seen, '%f'), '0') END AS last_seen,
           event_type IN ('view', 'click') AND seen > TIMESTAMP '2024-01-01 00:00:00' AS healthy
    FROM (SELECT user_id, event_type, ts AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    WHERE n = 1 ORDER BY seen DESC, user_id LIMIT 100""",
)
area.sql(
    "transition_violations",
    """
    SELECT old_type, event_type AS new_type, count(*) AS n FROM (
      SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_type FROM {events}) t
    WHERE old_type IS NOT NULL AND (old_type, event_type) NOT IN
      (('signup', 'view'), ('view', 'view'), ('view', 'click'), ('click', 'view'), ('click', 'purchase'), ('purchase', 'view'), ('error', 'view'))
    GROUP BY old_type, event_type""",
)
area.sql(
    "publication_violations",
    """
    SELECT d.source, d.lang, count(*) AS documents FROM {documents} d
    WHERE NOT EXISTS (SELECT 1 FROM {labels} l JOIN {documents} e ON e.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0 AND e.source = d.source AND e.lang = d.lang)
    GROUP BY d.source, d.lang""",
)
area.sql(
    "late_result_fencing",
    """
    SELECT event_type, sum(CASE WHEN gap IS NULL OR gap <= 3600 THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) AS fenced FROM (
      SELECT event_type, unix_timestamp(CAST(ts AS TIMESTAMP)) - unix_timestamp(CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS TIMESTAMP)) AS gap FROM {events}) t
    GROUP BY event_type""",
    """
    SELECT event_type, CAST(sum(CASE WHEN gap IS NULL OR gap <= 3600 THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) AS BIGINT) AS fenced FROM (
      SELECT event_type, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap FROM events) t
    GROUP BY event_type""",
)
area.sql(
    "lease_recovery_decisions",
    """
    SELECT o_orderkey AS job_id, attempts, CASE
        WHEN o_orderstatus = 'F' THEN 'finished'
        WHEN o_totalprice < 0 THEN 'cancelled'
        WHEN o_orderpriority LIKE '1%' AND attempts >= 3 THEN 'failed_after_provider'
        WHEN attempts >= 5 THEN 'failed'
        ELSE 'requeued' END AS decision,
      least(3600, 30 * CAST(power(2, greatest(least(attempts, 20) - 1, 0)) AS BIGINT)) AS delay_seconds
    FROM (SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderpriority, count(l.l_orderkey) AS attempts
          FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderpriority) t""",
)
area.sql(
    "event_json_props",
    "SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n FROM {events} GROUP BY CAST(get_json_object(props, '$.k') AS BIGINT), event_type",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n FROM events GROUP BY ALL",
)
area.sql(
    "tumbling_window_counts",
    "SELECT event_type, CAST(date_trunc('hour', ts) AS STRING) AS hour_start, count(*) AS n FROM {events} GROUP BY event_type, date_trunc('hour', ts)",
    "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start, count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)",
)
area.sql(
    "rate_rolling_window",
    """
    SELECT event_id, user_id, count(*) OVER w AS requests, CAST(sum(units) OVER w AS BIGINT) AS units FROM (
      SELECT event_id, user_id, unix_timestamp(CAST(ts AS TIMESTAMP)) AS second, CAST(floor(abs(value)) AS BIGINT) AS units FROM {events}) t
    WINDOW w AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)""",
    """
    SELECT event_id, user_id, count(*) OVER w AS requests, CAST(sum(units) OVER w AS BIGINT) AS units FROM (
      SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, CAST(floor(abs(value)) AS BIGINT) AS units FROM events) t
    WINDOW w AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)""",
)
area.sql(
    "map_merge_stage_counts",
    """
    SELECT user_id, coalesce(merged['view'], 0) AS views, coalesce(merged['error'], 0) AS errors, CAST(size(merged) AS BIGINT) AS stages FROM (
      SELECT user_id, map_zip_with(map_from_entries(early), map_from_entries(late), (k, a, b) -> coalesce(a, 0L) + coalesce(b, 0L)) AS merged FROM (
        SELECT user_id, collect_list(struct(event_type, n)) FILTER (WHERE half = 0) AS early, collect_list(struct(event_type, n)) FILTER (WHERE half = 1) AS late
        FROM (SELECT user_id, event_type, CAST(event_id % 2 AS INT) AS half, count(*) AS n FROM {events} GROUP BY user_id, event_type, CAST(event_id % 2 AS INT)) t
        GROUP BY user_id) u) v""",
    """
    SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS stages
    FROM events GROUP BY user_id""",
)
area.sql(
    "retention_plan",
    """
    SELECT category, id FROM (
      SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY made, id) AS n FROM (
        SELECT 'events' AS category, event_id AS id, ts AS made FROM {events} WHERE ts < (SELECT max(ts) - INTERVAL 7 DAYS FROM {events})
        UNION ALL
        SELECT 'orders', o_orderkey, o_orderdate FROM {orders} o
        WHERE o_orderdate < (SELECT max(o_orderdate) - INTERVAL 365 DAYS FROM {orders}) AND NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')) t) u
    WHERE n <= 500""",
)
area.sql(
    "length_framed_identity",
    "SELECT p_partkey, sha2(concat(octet_length(p_name), ':', p_name, octet_length(p_brand), ':', p_brand, octet_length(p_type), ':', p_type), 256) AS identity FROM {part}",
    "SELECT p_partkey, sha256(concat(strlen(p_name), ':', p_name, strlen(p_brand), ':', p_brand, strlen(p_type), ':', p_type)) AS identity FROM part",
)
area.sql(
    "option_validity",
    """
    SELECT p_partkey, n_options, distinct_options, distinct_options = 4 AND matches = 1 AND longest <= 500 AS valid FROM (
      SELECT p_partkey, size(o) AS n_options, size(array_distinct(o)) AS distinct_options, size(filter(o, x -> x = lower(trim(p_brand)))) AS matches, array_max(transform(o, x -> length(x))) AS longest FROM (
        SELECT p_partkey, p_brand, transform(array(p_name, p_brand, p_type, CASE WHEN p_size % 7 = 0 THEN p_brand ELSE CAST(p_size AS STRING) END), x -> lower(trim(x))) AS o FROM {part}) t) u""",
    """
    SELECT p_partkey, CAST(len(o) AS INT) AS n_options, CAST(len(list_distinct(o)) AS INT) AS distinct_options,
           len(list_distinct(o)) = 4 AND len(list_filter(o, lambda x: x = lower(trim(p_brand)))) = 1 AND list_max(list_transform(o, lambda x: length(x))) <= 500 AS valid FROM (
      SELECT p_partkey, p_brand, list_transform([p_name, p_brand, p_type, CASE WHEN p_size % 7 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END], lambda x: lower(trim(x))) AS o FROM part) t""",
)
area.sql(
    "hamilton_allocation",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(base + CASE WHEN n <= 20 - given THEN 1 ELSE 0 END AS BIGINT) AS share FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, base, sum(base) OVER (PARTITION BY l_orderkey) AS given,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(floor(20 * weight / total) AS BIGINT) AS base, (20 * weight) % total AS rest FROM (
          SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, weight, CAST(sum(weight) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total FROM (
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, greatest(1, CAST(l_quantity AS BIGINT)) AS weight FROM {lineitem}) w) t) f) r""",
)
area.sql(
    "adaptive_allocation",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN place <= 10 THEN 1 ELSE 0 END + CASE WHEN 10 > n THEN CAST(floor((10 - n + n - place) / n) AS BIGINT) ELSE 0 END AS BIGINT) AS share FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS n,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN asked = 0 THEN 0 ELSE 1 END, CASE WHEN asked = 0 THEN 0 ELSE -got END, CASE WHEN asked = 0 THEN 0 ELSE asked END, turn, page, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, page, asked, got, row_number() OVER (PARTITION BY l_orderkey, page ORDER BY asked, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS turn FROM (
          SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_suppkey % 3 AS BIGINT) AS page, CAST(l_partkey % 3 AS BIGINT) AS asked, CAST(l_partkey % 2 AS BIGINT) AS got FROM {lineitem}) a) b) c""",
)


@area.plan("""
    SELECT event_type, count(*) AS n, CAST(count(*) FILTER (WHERE value > 90) AS BIGINT) AS slow, round(avg(value), 4) AS mean,
           (SELECT v FROM (SELECT value AS v, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS m FROM
             (SELECT value FROM events e WHERE e.event_type = x.event_type ORDER BY ts DESC, event_id LIMIT 1000)) WHERE k = least(m - 1, CAST(floor(m * 0.95) AS BIGINT)) + 1) AS recent_p95
    FROM events x GROUP BY event_type""")
def error_rate_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.error_rate_latency(table(spark, sf_dir, "events"))


@area.plan("""
    SELECT p_brand, count(*) AS jobs, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_units, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS output_units,
           CAST(sum(CAST(ceil(CAST(l_quantity AS DECIMAL(18, 0)) * 0.15 + CAST(l_linenumber AS DECIMAL(18, 0)) * 0.6) AS BIGINT)) AS BIGINT) AS cost_units
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.usage_by_model(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


@area.plan("""
    SELECT (SELECT count(*) FROM events) AS requests, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors,
           (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS queue_depth,
           (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) FROM lineitem) AS units""")
def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.telemetry(*(table(spark, sf_dir, t) for t in ("events", "orders", "lineitem")))


_DAILY = "SELECT user_id, date_trunc('day', ts) AS day, count(*) AS jobs, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS units FROM events GROUP BY user_id, date_trunc('day', ts)"


@area.plan(f"SELECT user_id, strftime(day, '%Y-%m-%d') AS day, jobs, units, greatest(0, 20 - jobs) AS jobs_left, greatest(0, 1000 - units) AS units_left FROM ({_DAILY})")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.daily_quota(table(spark, sf_dir, "events"), 20, 1000)


@area.plan(f"SELECT * FROM (SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN jobs > 3 THEN 'jobs' WHEN units > 150 THEN 'units' END AS violation FROM ({_DAILY})) WHERE violation IS NOT NULL")
def quota_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.quota_violations(table(spark, sf_dir, "events"), 3, 150)


@area.plan("""
    SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders, coalesce(k, '') AS order_keys, coalesce(t, 0) AS cents
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS k,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def account_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.account_export(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))
