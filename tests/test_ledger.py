"""The run ledger: effects, attempts, kept errors, deadlines, and the stream against the batch fold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from augur.functions import text
from augur.operators import ledger
from augur.streaming import ledger as live

T = dt.datetime(2026, 8, 1, 12)
EVENTS = "unit string, ts timestamp, seq long, deadline timestamp, event string, error string, evidence string, route string"


def at(hours):
    return T + dt.timedelta(hours=hours)


def events(spark, *rows, deadline=None):
    """(unit, hours, event, error)"""
    return spark.createDataFrame([(u, at(h), i, deadline, e, error, None, None) for i, (u, h, e, error) in enumerate(rows)], EVENTS)


def sources(spark, *rows, **named):
    return {r["unit"]: r for r in ledger.folded(ledger.source_effects(events(spark, *rows, **named))).collect()}


def entrants(spark, *rows, now="2027-01-01", **named):
    return {r["unit"]: r for r in ledger.missed(ledger.folded(ledger.entrant_effects(events(spark, *rows, **named))), now).collect()}


def test_a_running_attempt_keeps_what_is_known(spark):
    found = sources(spark, ("a", 0, "started", None), ("a", 1, "failed", "it timed out"), ("a", 2, "started", None), ("b", 0, "started", None), ("c", 0, "failed", " "), ("d", 0, "failed", None), ("d", 3, "succeeded", None))
    assert (found["a"]["state"], found["a"]["attempts"], found["a"]["last_error"], found["a"]["next_retry"], found["a"]["alert"]) == ("retryable_failure", 2, "it timed out", at(7), True)
    assert found["a"]["required_action"] == ledger.WAIT_SOURCE
    assert (found["b"]["state"], found["b"]["attempts"], found["b"]["alert"]) == ("retryable_failure", 1, False)
    assert found["c"]["last_error"] == "unknown error" and found["c"]["attempts"] == 1
    assert (found["d"]["state"], found["d"]["last_error"], found["d"]["next_retry"], found["d"]["attempts"]) == ("healthy", None, None, 1)


def test_an_archive_is_never_healthy(spark):
    found = sources(spark, ("a", 0, "degraded", "HTTP 503"), ("b", 0, "stale", None), ("c", 0, "failed", "the page is a frozen page"), ("d", 0, "failed", "workbook is not an XLSX"))
    assert (found["a"]["state"], found["a"]["evidence"], found["a"]["required_action"]) == ("stale", [ledger.ARCHIVE_USED], ledger.RESTORE)
    assert found["b"]["state"] == found["c"]["state"] == "stale" and found["d"]["state"] == "unresolvable" and found["d"]["next_retry"] is None
    soon = sources(spark, ("a", 0, "degraded", "HTTP 503"), ("c", 0, "failed", "a frozen page"), ("d", 0, "failed", "HTTP 404"), ("e", 0, "failed", "timed out"), deadline=at(6))
    assert [soon[u]["state"] for u in "acde"] == ["deadline_risk", "deadline_risk", "unresolvable", "deadline_risk"]
    assert soon["c"]["required_action"] == ledger.UNCHANGED and soon["a"]["required_action"] == ledger.RESTORE_NOW


@pytest.mark.parametrize("message", text.MALFORMED)
def test_malformed_replies_are_terminal_for_sources_only(spark, message):
    row = spark.range(1).select(text.terminal(F.lit(f"x {message.upper()} y"), source=True).alias("s"), text.terminal(F.lit(f"x {message} y")).alias("e")).first()
    assert row["s"] and not row["e"]


def test_attempts_of_entrants(spark):
    found = entrants(spark, *[("a", i, e, None) for i, e in enumerate(("queued", "started", "deferred", "deferred", "started", "withheld"))], ("b", 0, "failed", "HTTP 401"), ("c", 0, "succeeded", "HTTP 500"), ("d", 0, "queued", None))
    assert (found["a"]["state"], found["a"]["attempts"], found["a"]["last_error"], found["a"]["next_retry"]) == ("queued", 1, ledger.CEILING, at(11))
    assert (found["b"]["state"], found["b"]["attempts"], found["b"]["next_retry"], found["b"]["required_action"]) == ("terminal_failure", 1, None, ledger.CREDENTIALS)
    assert (found["c"]["state"], found["c"]["attempts"], found["c"]["alert"], found["c"]["evidence"]) == ("succeeded", 2, True, [ledger.STANDBY])
    counts = ledger.report(ledger.folded(ledger.entrant_effects(events(spark, ("d", 0, "queued", None)))), ledger.ENTRANT_STATES).collect()
    assert {r["state"]: r["n"] for r in counts} == dict.fromkeys(ledger.ENTRANT_STATES, 0) | {"queued": 1}


def test_what_has_not_succeeded_by_its_deadline_has_missed_its_lock(spark):
    rows = [("won", 0, "succeeded", None), ("dead", 0, "failed", "HTTP 403"), ("idle", 0, "queued", None), ("late", 0, "queued", None), ("late", 9, "failed", "timed out"), ("won", 9, "started", None)]
    found = entrants(spark, *rows, deadline=at(8))
    assert {u: r["state"] for u, r in found.items()} == {"won": "succeeded", "dead": "missed_lock", "idle": "missed_lock", "late": "missed_lock"}
    assert found["late"]["last_error"] == "timed out" and found["idle"]["last_error"] == found["dead"]["last_error"] == ledger.NO_FORECAST
    assert entrants(spark, *rows, deadline=at(8), now=str(at(7)))["idle"]["state"] == "queued"


def test_the_stream_folds_batch_by_batch_and_forgets(spark, tmp_path):
    """Three batches give the batch's rows; a late event far ahead closes deadlines and drops what nobody asks about."""
    rows = [("a", 0, "queued", None), ("a", 1, "started", None), ("b", 1, "queued", None), ("a", 2, "failed", "timed out"), ("b", 3, "started", None), ("b", 4, "succeeded", None), ("a", 5, "started", None)]
    every = events(spark, *rows, deadline=at(30)).persist()
    for i, (low, high) in enumerate(((0, 3), (3, 5), (5, 9))):
        every.where(F.col("seq").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"batch={i}"))
    end = [("z", 24 * 400, "queued", None)]
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []

    def run():
        query = live.ledger(ledger.entrant_effects(stream), missing=True).writeStream.outputMode("update").foreachBatch(lambda batch, n: seen.extend((n, r["unit"], r["state"], r["attempts"], r["last_error"]) for r in batch.collect()))
        done = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        done.awaitTermination()
        return done

    run()
    last = {unit: rest for _, unit, *rest in seen}
    batch = {r["unit"]: [r["state"], r["attempts"], r["last_error"]] for r in ledger.folded(ledger.entrant_effects(every)).collect()}
    assert last == batch == {"a": ["running", 2, "timed out"], "b": ["succeeded", 1, None]}
    events(spark, *end, deadline=at(24 * 500)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "batch=9"))
    done = run()
    last = {unit: rest for _, unit, *rest in seen}
    assert last["a"] == ["missed_lock", 2, ledger.NO_FORECAST] and last["b"] == ["succeeded", 1, None]
    state = done.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= 3  # the last unit's row and its timers
