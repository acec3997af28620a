"""Streaming queries over events, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.plans import study
from loomstone.plans.shared import Catalogue
from loomstone.sources import folders
from loomstone.streaming import counters, learner

area = Catalogue()


@area.plan(f"SELECT user_id, card, interval_days, ease, n_correct, n_incorrect FROM ({study.area.oracles['sm2_progress']})")
def stream_sm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learner.drain(learner.learner_state(learner.event_stream(spark, sf_dir)), "update", folders.shared(spark, "stream"))
    last = Window.partitionBy("user_id", "card").orderBy(F.desc("batch"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "batch")


@area.plan("SELECT DISTINCT user_id, props FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.drain(learner.first_receipts(learner.event_stream(spark, sf_dir)), "append", folders.shared(spark, "stream")).drop("batch")


@area.plan("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learner.drain(learner.hourly(learner.event_stream(spark, sf_dir)), "update", folders.shared(spark, "stream"))
    latest = rows.groupBy("hour_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return latest.select(F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "event_type", "n")


_ALIVE = """
    SELECT event_id, user_id, day, lag(size) OVER w AS before, size AS after FROM (
      SELECT event_id, user_id, props, ts, date_trunc('day', ts) AS day, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS size FROM """


@area.plan("""
    WITH l AS (SELECT user_id, size FROM (
      SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS size, row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND size IS NOT NULL)
    SELECT 'user' AS scope, CAST(user_id AS VARCHAR) AS scope_id, count(*) AS rows_held, CAST(sum(size) AS BIGINT) AS bytes_held FROM l GROUP BY user_id
    UNION ALL SELECT 'all', '', count(*), CAST(coalesce(sum(size), 0) AS BIGINT) FROM l""")
def usage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events write, change and (errors) remove the entry of a user's key; totals are kept by what each change adds or takes.

    The log of changes, with the sizes before and after each, comes in files a few to a micro-batch.
    """
    log = spark.sql(_ALIVE + "{events}) e WINDOW w AS (PARTITION BY user_id, props ORDER BY ts, event_id)", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    folder = folders.shared(spark, "usage")
    log.repartition(6, "user_id").write.parquet(f"{folder}/log")
    changes = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    return counters.keep(changes, folder, {"user": "user_id", "all": None}, "before", "after")
