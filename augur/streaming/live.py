"""The refresh as streams: first prints, complete weeks, answers before a deadline, and the state of each source.

Everything is a windowed or keyed aggregation that Spark plans; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augur.operators.rules import source_state

#: Where a Monday week and a Sunday week start, counted from the epoch (a Thursday).
MONDAY, SUNDAY = "4 days", "3 days"


def weekly_totals(events: DataFrame, late: str = "2 days", starts: str = MONDAY) -> DataFrame:
    """Sums of complete weeks, Monday to Sunday (starts=SUNDAY: Sunday to Saturday), closed by the watermark; a week counts if it saw all seven days."""
    weeks = events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime=starts), "event_type")
    days = F.size(F.collect_set(F.to_date("ts")))
    return weeks.agg(F.sum("value").alias("total"), days.alias("days")).where("days = 7").select(F.col("window.start").cast("date").alias("week_start"), "event_type", "total")


def trailing(events: DataFrame, span: str = "21 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Means over sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", span, step), "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def first_arrivals(rows: DataFrame, key: list[str], late: str = "7 days") -> DataFrame:
    """The first row to arrive of each key holds."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def last_before_lock(answers: DataFrame, late: str = "7 days") -> DataFrame:
    """entrant, round_id, lock_at, version, received_at: updates of the last version received before the lock; late ones don't count.

    answers: entrant, round_id, version, received_at, lock_at. The watermark runs on the locks, so the state of a round
    goes when it can take no more answers.
    """
    held = answers.where("received_at < lock_at").withWatermark("lock_at", late)
    return held.groupBy("entrant", "round_id", "lock_at").agg(F.max_by(F.struct("version", "received_at"), F.struct("received_at", "version")).alias("_r")).select("entrant", "round_id", "lock_at", "_r.*")


def late_answers(answers: DataFrame) -> DataFrame:
    """The answers that last_before_lock refuses, for a side output."""
    return answers.where("received_at >= lock_at")


def source_states(attempts: DataFrame) -> DataFrame:
    """source, attempts, state, at: updates of each source's state by its newest attempt. One row of state for each source.

    attempts: source, ts, ok, stale, error, deadline (see rules.source_state).
    """
    state = source_state(F.col("ok"), F.col("stale"), F.col("error"), F.col("ts"), F.col("deadline"))
    newest = F.max_by(F.struct(state.alias("state"), F.col("ts").alias("at")), F.struct("ts", "attempt"))
    return attempts.groupBy("source").agg(F.count("*").alias("attempts"), newest.alias("_r")).select("source", "attempts", "_r.*")


def write_resolved(df: DataFrame, path: str, key: list[str], checkpoint: str):  # noqa: ANN201
    """A query that adds unseen keys to a table with every batch, so a replayed batch adds nothing."""
    from augur.sources.sinks import append_new

    return df.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
