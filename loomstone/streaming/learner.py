"""Structured Streaming forms: learner state, first receipts and hourly windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.operators.study import EASE, answered

STATE = "cards array<struct<card: string, days: int, ease: double, n_correct: long, n_incorrect: long, waiting: array<struct<ts: long, event_id: long, correct: boolean>>>>"
OUT = "user_id long, card string, interval_days int, ease double, n_correct long, n_incorrect long"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with a zoned event time."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # the stream source lists folders: a single file is matched by its own name
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/events*.parquet")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(name).isDirectory()


def _answered(state: tuple, tries: list[tuple]) -> tuple:
    days, ease, right, wrong = state
    for *_, correct in tries:
        days, ease = answered(days, ease, correct)
        right, wrong = right + correct, wrong + (not correct)
    return days, ease, right, wrong


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Continue the state of a learner's cards in the order of event time, whatever order the attempts arrive in.

    Attempts wait in the state until the watermark has passed them, since an earlier one may still arrive; what is told of a
    card meanwhile has the waiting ones in it, in order.  A learner is one group, since a group costs far more than its rows.
    """
    cards = {}
    for c in state.get[0] if state.exists else ():
        waiting = [(int(w["ts"]), int(w["event_id"]), bool(w["correct"])) for w in c["waiting"]]
        cards[c["card"]] = ((int(c["days"]), float(c["ease"]), int(c["n_correct"]), int(c["n_incorrect"])), waiting)
    touched = set()
    if not state.hasTimedOut:
        for batch in batches:
            for card, t, i, c in zip(*(batch[x].tolist() for x in ("card", "at", "event_id", "correct")), strict=True):
                cards.setdefault(card, ((0, EASE, 0, 0), []))[1].append((int(t), int(i), bool(c)))
                touched.add(card)
    passed = state.getCurrentWatermarkMs() * 1000
    held, rows, first = [], [], None
    for card, (done, tries) in cards.items():
        tries = sorted(tries)
        settled = [x for x in tries if x[0] < passed]
        done, tries = _answered(done, settled), tries[len(settled) :]
        held.append({"card": card, **dict(zip(("days", "ease", "n_correct", "n_incorrect"), done, strict=True)), "waiting": [{"ts": t, "event_id": i, "correct": c} for t, i, c in tries]})
        if tries:
            first = tries[0][0] if first is None else min(first, tries[0][0])
        if card in touched or settled:
            days, ease, right, wrong = _answered(done, tries)
            rows.append((*key, card, days, round(ease, 6), right, wrong))
    state.update((held,))
    if first is not None:
        state.setTimeoutTimestamp(max(first // 1000 + 1, passed // 1000 + 1))
    yield pd.DataFrame(rows, columns=["user_id", "card", "interval_days", "ease", "n_correct", "n_incorrect"])


def learner_state(stream: DataFrame, passing: float = 50.0, lateness: str = "60 days") -> DataFrame:
    """The state of every (user, card) after each micro-batch that touched it.

    Attempts count in the order of their event time over all micro-batches.  State holds those of the last ``lateness``; an
    attempt that arrives later than that behind the newest is dropped by the watermark.
    """
    tries = stream.withWatermark("ts", lateness).select("user_id", F.col("event_type").alias("card"), "event_id", "ts", F.unix_micros("ts").alias("at"), (F.col("value") >= passing).alias("correct"))
    return tries.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def first_receipts(stream: DataFrame) -> DataFrame:
    """One row per (user, props): receipts never expire, so the state is kept without a watermark."""
    return stream.select("user_id", "props").dropDuplicates(["user_id", "props"])


def hourly(stream: DataFrame, lateness: str = "60 days") -> DataFrame:
    """Tumbling hourly counts by event time; rows later than ``lateness`` are dropped by the watermark."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour_start"), "event_type", "n")


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run what is available to its end and return the rows that were written."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}x")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows/*")
