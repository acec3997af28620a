"""Learner state: the scheduling fold, queues, progress and idempotent receipts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the schedule: first intervals, ease bounds and status limits.
FIRST, SECOND, EASE, LEAST_EASE, REVIEW_DAYS, MASTERED_DAYS = 1, 6, 2.5, 1.3, 7, 21


def attempts(events: DataFrame, passing: float = 50.0) -> DataFrame:
    """Events read as study attempts: one card per event type, correct from a value on."""
    return events.select("user_id", F.col("event_type").alias("card"), "event_id", "ts", (F.col("value") >= passing).alias("correct"))


def answered(days: int, ease: float, correct: bool) -> tuple[int, float]:
    """Interval and ease after one answer: quality 5 if correct, else 1, which starts the interval again."""
    if not correct:
        return 0, ease
    return {0: FIRST, FIRST: SECOND}.get(days) or round(days * ease), max(LEAST_EASE, ease + 0.1)


def progress(tries: DataFrame) -> DataFrame:
    """State of every user and card after the ordered fold of its attempts.

    Attempts stream through each task in the order of user, card and time, with one state held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, [0, EASE, 0, 0, None]
        for batch in batches:
            done = []
            for user, card, at, correct in zip(batch["user_id"], batch["card"], batch["ts"], batch["correct"], strict=True):
                if (user, card) != key:
                    if key is not None:
                        done.append((*key, *state))
                    key, state = (user, card), [0, EASE, 0, 0, None]
                state[0], state[1] = answered(state[0], state[1], correct)
                state[2 if correct else 3] += 1
                state[4] = at
            yield pd.DataFrame(done, columns=names)
        if key is not None:
            yield pd.DataFrame([(*key, *state)], columns=names)

    names = ["user_id", "card", "days", "ease", "n_correct", "n_incorrect", "last_reviewed"]
    ordered = tries.repartition("user_id", "card").sortWithinPartitions("user_id", "card", "ts", "event_id").select("user_id", "card", "ts", "correct")
    folded = ordered.mapInPandas(run, "user_id long, card string, days int, ease double, n_correct long, n_incorrect long, last_reviewed timestamp_ntz")
    days = F.col("days")
    status = F.when(days >= MASTERED_DAYS, "mastered").when(days >= REVIEW_DAYS, "review").otherwise("learning")
    return folded.select(
        "user_id", "card", days.alias("interval_days"), F.round("ease", 6).alias("ease"), "n_correct", "n_incorrect", status.alias("status"), "last_reviewed",
        (F.col("last_reviewed") + F.make_dt_interval(days)).alias("next_review"),
    )


def percent(part: Column, whole: Column) -> Column:
    """One decimal, halves to even; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole * 100, 1))


def set_progress(state: DataFrame, cards: int) -> DataFrame:
    """Counts and percentages of every user over a set of ``cards`` cards."""
    of = lambda s: F.count_if(F.col("status") == s)
    total = F.lit(cards).cast("long")
    tally = state.groupBy("user_id").agg(F.count("*").alias("studied"), of("learning").alias("learning"), of("review").alias("review"), of("mastered").alias("mastered"), F.sum("n_correct").alias("n_correct"), F.sum("n_incorrect").alias("n_incorrect"), F.count_if(F.col("n_correct") > 0).alias("ever_correct"))
    return tally.select(
        "user_id", total.alias("total"), (total - F.col("studied")).alias("new"), "learning", "review", "mastered", "studied", "n_correct", "ever_correct",
        percent(F.col("ever_correct"), total).alias("progress_percentage"),
        percent(F.col("n_correct"), F.col("n_correct") + F.col("n_incorrect")).alias("accuracy_percentage"),
        percent(F.col("studied"), total).alias("completion_percentage"),
        percent(F.col("review") + F.col("mastered"), total).alias("mastery_percentage"),
    )


def due_queue(cards: DataFrame, state: DataFrame, now: Column, most: int) -> DataFrame:
    """Per user the first cards that are unseen or due: seen ones first, by their due time."""
    known = cards.join(state.select("user_id", "card", "next_review"), ["user_id", "card"], "left")
    due = known.where(F.col("next_review").isNull() | (F.col("next_review") <= now))
    order = Window.partitionBy("user_id").orderBy(F.when(F.col("next_review").isNull(), 1).otherwise(0), F.asc_nulls_last("next_review"), "card")
    return due.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= most).select("user_id", "card", "position")


def review_queue(cards: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """Per user all cards by when they were last reviewed, never-reviewed ones first."""
    known = cards.join(state.select("user_id", "card", "last_reviewed"), ["user_id", "card"], "left")
    order = Window.partitionBy("user_id").orderBy(F.asc_nulls_first("last_reviewed"), "card")
    return known.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= most).select("user_id", "card", "position")


def receipts(events: DataFrame) -> DataFrame:
    """First submission of every (user, key) wins; the same content replays, other content conflicts."""
    submitted = events.select("user_id", F.sha2("props", 256).alias("key"), "event_id", "event_type")
    first = submitted.groupBy("user_id", "key").agg(F.min(F.struct("event_id", "event_type")).alias("f"))
    both = submitted.join(first, ["user_id", "key"])
    kind = F.when(F.col("event_id") == F.col("f.event_id"), "new").when(F.col("event_type") == F.col("f.event_type"), "replayed").otherwise("conflict")
    return both.select("event_id", F.col("f.event_id").alias("first_event_id"), kind.alias("outcome"))


def fixed_windows(events: DataFrame, seconds: int) -> DataFrame:
    """A counter per user whose window opens at its first hit and again at the first hit after it has passed.

    Hits stream through each task in the order of user and time, with one window held.
    """
    width = seconds * 1_000_000

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, n = None, 0, 0
        for batch in batches:
            counts = []
            for who, at in zip(batch["user_id"], batch["at"], strict=True):
                if who != user or start <= at - width:
                    user, start, n = who, at, 0
                n += 1
                counts.append(n)
            yield pd.DataFrame({"user_id": batch["user_id"], "event_id": batch["event_id"], "count": counts})

    hits = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return hits.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(count, "user_id long, event_id long, count long")
