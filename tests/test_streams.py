"""Streams whose files come out of order, one a micro-batch, against the batch forms of the same rules."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.operators import study
from loomstone.streaming import learner


def files(spark, folder, order, n=6):
    """The events in n files by time, written in the given order of parts."""
    rng = random.Random(5)
    rows = [(i, i // 40, rng.randrange(3), rng.choice("ab"), float(rng.randrange(100))) for i in range(40 * n)]
    events = spark.createDataFrame(rows, "event_id long, part int, user_id long, event_type string, value double")
    events = events.withColumn("ts", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, CAST(event_id AS INT) % 97 * 4, 0, 0)") + F.expr("make_interval(0, 0, 0, part)")))
    for k in order:
        events.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize(("order", "lateness"), [((3, 0, 5, 1, 4, 2), "60 days"), ((0, 1, 2, 3, 4, 5), "17 days"), ((1, 0, 2, 4, 3, 5), "20 days")])
def test_learner_state_by_event_time(spark, tmp_path, order, lateness):
    events = files(spark, f"{tmp_path}/in", order)
    rows = learner.drain(learner.learner_state(stream(spark, f"{tmp_path}/in"), lateness=lateness), "update", f"file://{tmp_path}/out")
    assert rows.select("batch").distinct().count() >= 6
    last = Window.partitionBy("user_id", "card").orderBy(F.desc("batch"))
    rows = rows.withColumn("n", F.row_number().over(last)).where("n = 1")
    pick = ["user_id", "card", "interval_days", "ease", "n_correct", "n_incorrect"]
    want = study.progress(study.attempts(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")))).select(*pick)
    assert sorted(map(tuple, rows.select(*pick).collect())) == sorted(map(tuple, want.collect()))


def test_a_learner_is_one_group(spark, tmp_path):
    """A group costs milliseconds whatever it holds, so the cards of a learner share one; a late card and a null one keep their own state."""
    rows = [(0, 1, "a", 80.0, 9), (1, 1, None, 80.0, 1), (2, 1, "a", 20.0, 5), (3, 1, "b", None, 3), (4, 2, "a", 90.0, 2)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, day int").selectExpr("event_id", "user_id", "event_type", "value", "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, day) AS ts")
    events.write.parquet(f"{tmp_path}/in")
    state = learner.learner_state(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    told = state._jdf.queryExecution().analyzed().toString()
    assert "WithState" in told and [x.split("#")[0] for x in told.split("WithState", 1)[1].split("[", 1)[1].split("]", 1)[0].split(", ")] == ["user_id"]
    got = {(r.user_id, r.card, r.interval_days, r.n_correct, r.n_incorrect) for r in learner.drain(state, "update", f"file://{tmp_path}/out").collect()}
    assert got == {(1, "a", study.FIRST, 1, 1), (1, None, study.FIRST, 1, 0), (1, "b", 0, 0, 1), (2, "a", study.FIRST, 1, 0)}
