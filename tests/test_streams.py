"""Streams, drained, against batch results and plain code."""

import datetime as dt

from pyspark.sql import functions as F

from augur.operators import asof
from augur.plans import registry
from augur.streaming import live

DATA = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet")


def test_everything_that_was_open_is_closed(spark):
    batch = {(r["week_end"] - dt.timedelta(6), r["event_type"]): r["total"] for r in registry.QUERIES["complete_weeks"](spark, DATA).collect()}
    found = {(r["week_start"], r["event_type"]): r["total"] for r in registry.QUERIES["stream_weekly_totals"](spark, DATA).collect()}
    assert found.keys() == batch.keys() and all(abs(batch[k] - v) < 0.01 for k, v in found.items())
    sessions = registry.QUERIES["stream_sessions"](spark, DATA).collect()
    assert sum(r["n"] for r in sessions) == events(spark).count()


def test_late_answers_go_to_the_side(spark):
    answers = events(spark).select(F.col("ts").alias("received_at"), F.lit("2024-01-20").cast("timestamp_ntz").alias("lock_at"))
    assert 0 < live.late_answers(answers).count() == answers.where("received_at >= lock_at").count() < answers.count()


def test_source_states(spark):
    from augur.operators.rules import source_state

    at, deadline = "2026-09-16 10:00:00", "2026-09-16 20:00:00"
    cases = [
        (True, False, None, at, deadline, "healthy"), (True, True, None, at, deadline, "stale"), (False, False, "timed out", at, deadline, "retryable_failure"), (False, False, "timed out", "2026-09-16 14:00:00", deadline, "deadline_risk"),
        (False, False, "timed out", at, None, "retryable_failure"), (False, False, "HTTP 404", "2026-09-16 14:00:00", deadline, "unresolvable"), (False, False, "failed to parse", at, deadline, "unresolvable"), (False, False, "a frozen page", at, deadline, "stale"),
        (False, False, "newest row is old; HTTP 403", "2026-09-16 14:00:00", deadline, "deadline_risk"),
    ]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, ok boolean, stale boolean, error string, at string, deadline string, want string")
    state = source_state(F.col("ok"), F.col("stale"), F.col("error"), F.col("at").cast("timestamp"), F.col("deadline").cast("timestamp"))
    assert all(r["want"] == r["got"] for r in frame.select("want", state.alias("got")).collect())


def test_asof_stretches_agree(spark):
    e = events(spark).withColumn("ts", F.col("ts").cast("timestamp"))
    left, right = e.where("event_id % 3 = 0").select("event_id", "event_type", "ts"), e.where("event_id % 3 = 1").select("event_type", F.col("ts").alias("at"), F.col("event_id").alias("seen"))
    rows = lambda d: sorted(map(tuple, d.select("event_id", "seen").collect()))
    for join in (asof.asof_backward, asof.asof_forward):
        assert rows(join(left, right, ["event_type"], "ts", "at", ["seen"], stretch=3600)) == rows(join(left, right, ["event_type"], "ts", "at", ["seen"], stretch=10**9))
