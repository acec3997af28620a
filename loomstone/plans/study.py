"""Study queries: events stand for attempts, an event type for a card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import study
from loomstone.plans.shared import Catalogue
from loomstone.sources.tables import table

area = Catalogue()
NOW = "2024-02-01 00:00:00"

_STATE = """
    WITH RECURSIVE a AS (
      SELECT user_id, event_type AS card, ts, value >= 50 AS correct, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    s AS (
      SELECT user_id, card, CAST(0 AS BIGINT) AS n, 0 AS days, CAST(2.5 AS DOUBLE) AS ease, CAST(0 AS BIGINT) AS n_correct, CAST(0 AS BIGINT) AS n_incorrect, CAST(NULL AS TIMESTAMP) AS last_reviewed
      FROM (SELECT DISTINCT user_id, card FROM a)
      UNION ALL
      SELECT s.user_id, s.card, a.n,
             CASE WHEN NOT a.correct THEN 0 WHEN s.days = 0 THEN 1 WHEN s.days = 1 THEN 6 ELSE CAST(round_even(s.days * s.ease, 0) AS INT) END,
             CASE WHEN a.correct THEN greatest(1.3, s.ease + 0.1) ELSE s.ease END,
             s.n_correct + CASE WHEN a.correct THEN 1 ELSE 0 END, s.n_incorrect + CASE WHEN a.correct THEN 0 ELSE 1 END, a.ts
      FROM s JOIN a ON a.user_id = s.user_id AND a.card = s.card AND a.n = s.n + 1),
    p AS (
      SELECT user_id, card, days AS interval_days, round(ease, 6) AS ease, n_correct, n_incorrect,
             CASE WHEN days >= 21 THEN 'mastered' WHEN days >= 7 THEN 'review' ELSE 'learning' END AS status, last_reviewed, last_reviewed + to_days(days) AS next_review
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, card ORDER BY n DESC) AS k FROM s) WHERE k = 1)"""
_CARDS = "cards AS (SELECT u.user_id, c.card FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type AS card FROM events) c)"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.progress(study.attempts(table(spark, sf_dir, "events")))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user with every card of the set; the set is the few event types."""
    events = table(spark, sf_dir, "events")
    kinds = events.groupBy("event_type").agg(F.count("*").alias("n")).agg(F.collect_list("event_type").alias("kinds"))
    return events.select("user_id").distinct().crossJoin(kinds).select("user_id", F.explode("kinds").alias("card"))


@area.plan(_STATE + " SELECT user_id, card, interval_days, ease, n_correct, n_incorrect, status FROM p")
def sm2_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).drop("last_reviewed", "next_review")


@area.plan(_STATE + """
    SELECT user_id, CAST(5 AS BIGINT) AS total, 5 - count(*) AS new, count(*) FILTER (status = 'learning') AS learning, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'mastered') AS mastered,
           count(*) AS studied, CAST(sum(n_correct) AS BIGINT) AS n_correct, count(*) FILTER (n_correct > 0) AS ever_correct,
           round_even(count(*) FILTER (n_correct > 0) / 5 * 100, 1) AS progress_percentage, round_even(sum(n_correct) / (sum(n_correct) + sum(n_incorrect)) * 100, 1) AS accuracy_percentage,
           round_even(count(*) / 5 * 100, 1) AS completion_percentage, round_even(count(*) FILTER (status <> 'learning') / 5 * 100, 1) AS mastery_percentage
    FROM p GROUP BY user_id""")
def set_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.set_progress(_state(spark, sf_dir), 5)


@area.plan(_STATE + f""", {_CARDS}
    SELECT user_id, card, position FROM (
      SELECT c.user_id, c.card, row_number() OVER (PARTITION BY c.user_id ORDER BY CASE WHEN next_review IS NULL THEN 1 ELSE 0 END, next_review, c.card) AS position
      FROM cards c LEFT JOIN p ON p.user_id = c.user_id AND p.card = c.card WHERE next_review IS NULL OR next_review <= TIMESTAMP '{NOW}') WHERE position <= 3""")
def due_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.due_queue(_cards(spark, sf_dir), _state(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), 3)


@area.plan(_STATE + f""", {_CARDS}
    SELECT user_id, card, position FROM (
      SELECT c.user_id, c.card, row_number() OVER (PARTITION BY c.user_id ORDER BY last_reviewed NULLS FIRST, c.card) AS position
      FROM cards c LEFT JOIN p ON p.user_id = c.user_id AND p.card = c.card) WHERE position <= 4""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.review_queue(_cards(spark, sf_dir), _state(spark, sf_dir), 4)


@area.plan("""
    SELECT event_id, first_event_id, CASE WHEN event_id = first_event_id THEN 'new' WHEN event_type = first_type THEN 'replayed' ELSE 'conflict' END AS outcome FROM (
      SELECT event_id, event_type, first_value(event_id) OVER w AS first_event_id, first_value(event_type) OVER w AS first_type
      FROM events WINDOW w AS (PARTITION BY user_id, props ORDER BY event_id))""")
def idempotent_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.receipts(table(spark, sf_dir, "events"))


@area.plan("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (
      SELECT user_id, event_id, n, ts AS start, CAST(1 AS BIGINT) AS count FROM e WHERE n = 1
      UNION ALL
      SELECT e.user_id, e.event_id, e.n, CASE WHEN s.start <= e.ts - INTERVAL 300 SECONDS THEN e.ts ELSE s.start END, CASE WHEN s.start <= e.ts - INTERVAL 300 SECONDS THEN 1 ELSE s.count + 1 END
      FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, event_id, count FROM s""")
def rate_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.fixed_windows(table(spark, sf_dir, "events"), 300)
