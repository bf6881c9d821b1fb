"""Queries: the streams, run over the events table to its end and closed, so that they give the batch result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.plans.fixtures import r, rounded, table
from augur.plans.registry import query
from augur.session import shared_dir
from augur.operators import ledger
from augur.streaming import ledger as live_ledger
from augur.streaming import live

#: Later than all events: a row of this time alone moves the watermark beyond them. It has no other values.
END = "2100-01-01 00:00:00"


def drained(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], mode: str, key: list[str] | None = None) -> DataFrame:
    """All that a stream over events has to say once its input is used up and closed.

    The stream runs twice from one checkpoint: over the events, then over a row of time END, by which the watermark
    closes what is still open. key: of update streams, of which the last version holds. Results and checkpoints lie in
    the shared folder.
    """
    base = f"{shared_dir(spark).rstrip('/')}/augur/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    closing = spark.range(1).select(*[F.lit(END if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in schema])
    closing.limit(0).write.parquet(f"{base}/closing")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = build(events.unionByName(spark.readStream.schema(schema).parquet(f"{base}/closing")).withColumn("ts", F.col("ts").cast("timestamp")))

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    for end in (False, True):
        if end:
            closing.coalesce(1).write.mode("append").parquet(f"{base}/closing")
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").schema(stream.schema.add("_batch", "integer")).parquet(f"{base}/out")
    if key:
        found = found.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_batch")))).where("_n = 1").drop("_n")
    return found.drop("_batch")


@query(f"""SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, {r('sum(value)', 4)} AS total FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) = 7""")
def stream_weekly_totals(spark: SparkSession, d: str) -> DataFrame:
    return drained(spark, d, live.weekly_totals, "append").select("week_start", "event_type", rounded("total", 4).alias("total"))


@query(f"""WITH w AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS started, event_type, value FROM events, range(0, 21) t(k)) SELECT CAST(started AS DATE) AS started, event_type, {r('avg(value)', 4)} AS mean, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding_means(spark: SparkSession, d: str) -> DataFrame:
    found = drained(spark, d, live.trailing, "append").where("event_type is not null")
    return found.select(F.col("window.start").cast("date").alias("started"), "event_type", rounded("mean", 4).alias("mean"), "n")


@query("""SELECT 'u' || user_id AS entrant, event_type AS round_id, max_by(event_id, (ts, event_id)) AS version, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS received_at FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def stream_last_before_lock(spark: SparkSession, d: str) -> DataFrame:
    answers = lambda e: e.select(F.concat(F.lit("u"), "user_id").alias("entrant"), F.col("event_type").alias("round_id"), F.col("event_id").alias("version"), F.col("ts").alias("received_at"), F.lit("2024-01-20").cast("timestamp").alias("lock_at"))
    found = drained(spark, d, lambda e: live.last_before_lock(answers(e)), "update", ["entrant", "round_id"])
    return found.select("entrant", "round_id", "version", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("received_at"))


@query("""WITH a AS (SELECT 's' || user_id % 40 AS source, ts, event_id, event_type <> 'error' AS ok, event_type = 'signup' AS stale, CASE WHEN event_id % 5 = 0 THEN 'HTTP 403' WHEN event_id % 5 = 1 THEN 'HTTP 503: a frozen page' ELSE 'it timed out' END AS error, TIMESTAMP '2024-01-28' AS deadline FROM events),
  s AS (SELECT *, CASE WHEN ok THEN CASE WHEN stale THEN 'stale' ELSE 'healthy' END WHEN contains(error, 'frozen') THEN CASE WHEN ts + INTERVAL 6 HOURS >= deadline THEN 'deadline_risk' ELSE 'stale' END WHEN contains(error, '403') THEN 'unresolvable' WHEN ts + INTERVAL 6 HOURS >= deadline THEN 'deadline_risk' ELSE 'retryable_failure' END AS state FROM a)
  SELECT source, count(*) AS attempts, max_by(state, (ts, event_id)) AS state FROM s GROUP BY 1""")
def stream_run_states(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 5
    error = F.when(i == 0, "HTTP 403").when(i == 1, "HTTP 503: a frozen page").otherwise("it timed out")
    attempts = lambda e: e.where("event_id is not null").select(F.concat(F.lit("s"), F.col("user_id") % 40).alias("source"), "ts", F.col("event_id").alias("attempt"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "signup").alias("stale"), error.alias("error"), F.lit("2024-01-28").cast("timestamp").alias("deadline"))
    return drained(spark, d, lambda e: live.source_states(attempts(e)), "update", ["source"]).select("source", "attempts", "state")


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return drained(spark, d, lambda e: live.first_arrivals(e, ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "append").where("user_id is not null")


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
  SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, user_id, count(*) AS n, {r('sum(value)', 4)} AS total FROM s GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = drained(spark, d, live.sessions, "append")
    return found.select(F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started"), "user_id", "n", rounded("total", 4).alias("total"))


#: Events as attempts of sources, and as what happens to an entrant's rounds; by SQL the same.
ERRORS = ("HTTP 403", "HTTP 503: a frozen page", "it timed out", "workbook is NOT an xlsx", "   ", "the name served its index page", "the weekly rows are not weekly")
_KEPT = "unit, state, attempts, last_error, strftime(next_retry, '%Y-%m-%d %H:%M:%S') AS next_retry, required_action, alert, array_to_string(evidence, ';') AS evidence"
_FOLD = """f AS (SELECT unit, max_by(state, (ts, seq)) FILTER (state IS NOT NULL) AS state, list_reduce(list({'l': least_, 'm': more} ORDER BY ts, seq), lambda a, b: {'l': greatest(b.l, a.l + b.m), 'm': a.m + b.m}) AS n,
    arg_max_null(error, (ts, seq)) FILTER (sets_error) AS last_error, arg_max_null(next_retry, (ts, seq)) FILTER (sets_retry) AS next_retry, max_by(action, (ts, seq)) AS required_action, coalesce(max_by(alert, (ts, seq)) FILTER (alert IS NOT NULL), false) AS alert,
    list_sort(list_distinct(flatten(list(evidence)))) AS evidence, max(deadline) AS deadline FROM e GROUP BY 1),
  g AS (SELECT * REPLACE (coalesce(state, 'retryable_failure') AS state), CAST(greatest(n.l, n.m) AS INTEGER) AS attempts FROM f)"""
_ERROR = f"([{', '.join(repr(x) for x in ERRORS)}])[event_id % 7 + 1]"
_SOURCES = f"""WITH a AS (SELECT 's' || user_id % 40 AS unit, ts, event_id AS seq, TIMESTAMP '2024-01-28' AS deadline, event_type AS t, coalesce(nullif(trim({_ERROR}), ''), 'unknown error') AS error, ts + INTERVAL 6 HOURS >= TIMESTAMP '2024-01-28' AS risk, event_id FROM events),
  c AS (SELECT *, contains(error, 'frozen page') AS still, regexp_matches(lower(error), 'http (401|403|404)|not an xlsx|served its index page|not weekly') AND NOT contains(error, 'frozen page') AS dead FROM a),
  e AS (SELECT unit, ts, seq, deadline, CASE t WHEN 'click' THEN NULL WHEN 'view' THEN 'healthy' WHEN 'signup' THEN 'stale' WHEN 'purchase' THEN CASE WHEN dead THEN 'unresolvable' WHEN risk THEN 'deadline_risk' WHEN still THEN 'stale' ELSE 'retryable_failure' END ELSE CASE WHEN risk THEN 'deadline_risk' ELSE 'stale' END END AS state,
    CASE WHEN t = 'click' THEN 0 ELSE 1 END AS least_, CASE WHEN t = 'click' THEN 1 ELSE 0 END AS more, t <> 'click' AS sets_error, CASE WHEN t IN ('purchase', 'error') THEN error END AS error, t <> 'click' AS sets_retry, CASE WHEN t = 'error' OR t = 'purchase' AND NOT dead THEN ts + INTERVAL 6 HOURS END AS next_retry,
    CASE t WHEN 'click' THEN 'wait for the in-flight source attempt' WHEN 'view' THEN 'none' WHEN 'signup' THEN '{ledger.INSPECT}' WHEN 'purchase' THEN CASE WHEN dead THEN '{ledger.REPAIR}' WHEN still THEN CASE WHEN risk THEN '{ledger.UNCHANGED}' ELSE '{ledger.INSPECT}' END WHEN risk THEN '{ledger.HOLD}' ELSE '{ledger.NEXT_REFRESH}' END ELSE CASE WHEN risk THEN '{ledger.RESTORE_NOW}' ELSE '{ledger.RESTORE}' END END AS action,
    CASE WHEN t <> 'click' THEN t <> 'view' END AS alert, CASE WHEN t = 'error' THEN ['archive ' || event_id % 3, '{ledger.ARCHIVE_USED}'] ELSE ['archive ' || event_id % 3] END AS evidence FROM c), {_FOLD} SELECT {_KEPT} FROM g"""
_ENTRANTS = f"""WITH a AS (SELECT 'r' || user_id % 9 || '/e' || user_id % 5 AS unit, ts, event_id AS seq, TIMESTAMP '2024-01-20' + to_days(CAST(user_id % 9 AS INTEGER)) AS deadline, event_id % 6 AS k, CASE WHEN event_id % 7 < 5 THEN coalesce(nullif(trim({_ERROR}), ''), 'unknown error') END AS error, event_id FROM events),
  b AS (SELECT *, ts >= deadline AS past, ts + INTERVAL 6 HOURS >= deadline AS risk, coalesce(contains(error, '403'), false) AS dead FROM a WHERE ts < deadline OR k = 4),
  e AS (SELECT unit, ts, seq, deadline, CASE k WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'queued' WHEN 3 THEN 'succeeded' WHEN 4 THEN CASE WHEN past THEN 'missed_lock' WHEN dead THEN 'terminal_failure' ELSE 'retryable_failure' END ELSE 'queued' END AS state, CASE WHEN k = 4 THEN 1 WHEN k = 3 AND error IS NOT NULL THEN 2 ELSE 0 END AS least_,
    CASE k WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS more, k >= 3 AS sets_error, CASE k WHEN 3 THEN error WHEN 4 THEN coalesce(error, 'unknown entrant failure') WHEN 5 THEN 'withheld by the per-run spend ceiling' END AS error, true AS sets_retry, CASE WHEN k = 5 OR k = 4 AND NOT past AND NOT dead THEN ts + INTERVAL 6 HOURS END AS next_retry,
    CASE k WHEN 0 THEN 'wait for the filing worker' WHEN 1 THEN 'wait for the provider response' WHEN 4 THEN CASE WHEN past THEN '{ledger.MISS}' WHEN dead THEN '{ledger.CREDENTIALS}' WHEN risk THEN '{ledger.TOO_LATE}' ELSE $${ledger.KEEP_OTHERS}$$ END WHEN 5 THEN CASE WHEN risk THEN '{ledger.RAISE}' ELSE '{ledger.LEAVE}' END ELSE 'none' END AS action,
    CASE k WHEN 3 THEN error IS NOT NULL WHEN 4 THEN true WHEN 5 THEN true ELSE false END AS alert, CASE WHEN k <> 3 THEN [] WHEN error IS NULL THEN ['forecast=f' || event_id % 4] ELSE ['forecast=f' || event_id % 4, '{ledger.STANDBY}'] END AS evidence FROM b), {_FOLD},
  m AS (SELECT *, state NOT IN ('succeeded', 'missed_lock') AS gone FROM g), h AS (SELECT unit, attempts, evidence, CASE WHEN gone THEN 'missed_lock' ELSE state END AS state, CASE WHEN gone THEN '{ledger.NO_FORECAST}' ELSE last_error END AS last_error, CASE WHEN NOT gone THEN next_retry END AS next_retry, CASE WHEN gone THEN '{ledger.MISS}' ELSE required_action END AS required_action, gone OR alert AS alert FROM m) SELECT {_KEPT} FROM h"""


def source_attempts(e: DataFrame) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "started", "view", "succeeded", "signup", "stale", "purchase", "failed", "error", "degraded")]), F.col("event_type"))
    error = F.element_at(F.array(*[F.lit(x) for x in ERRORS]), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(F.concat(F.lit("s"), F.col("user_id") % 40).alias("unit"), "ts", F.col("event_id").alias("seq"), F.lit("2024-01-28").cast("timestamp").alias("deadline"), kind.alias("event"), error.alias("error"), F.concat(F.lit("archive "), F.col("event_id") % 3).alias("evidence"))


def entrant_events(e: DataFrame) -> DataFrame:
    user, i = F.col("user_id"), F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("queued", "started", "deferred", "succeeded", "failed", "withheld")]), (i % 6 + 1).cast("int"))
    error = F.when(i % 7 < 5, F.element_at(F.array(*[F.lit(x) for x in ERRORS]), (i % 7 + 1).cast("int")))
    deadline = F.lit("2024-01-20").cast("timestamp") + F.make_dt_interval((user % 9).cast("int"))
    return e.select(F.concat(F.lit("r"), user % 9, F.lit("/e"), user % 5).alias("unit"), "ts", i.alias("seq"), deadline.alias("deadline"), kind.alias("event"), error.alias("error"), F.concat(F.lit("f"), i % 4).alias("artifact"))


def told(rows: DataFrame) -> DataFrame:
    return rows.where("unit is not null").select("unit", "state", "attempts", "last_error", F.date_format("next_retry", "yyyy-MM-dd HH:mm:ss").alias("next_retry"), "required_action", "alert", F.array_join("evidence", ";").alias("evidence"))


def utc(d: DataFrame) -> DataFrame:
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


@query(_SOURCES)
def source_ledger(spark: SparkSession, d: str) -> DataFrame:
    """State, attempts, kept error, next retry, what to do and evidence of every source."""
    return told(ledger.folded(ledger.source_effects(source_attempts(utc(table(spark, d, "events"))))))


@query(_ENTRANTS)
def entrant_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The same for every entrant's round, after all deadlines."""
    return told(ledger.missed(ledger.folded(ledger.entrant_effects(entrant_events(utc(table(spark, d, "events"))))), "2024-02-28 00:00:00"))


@query(_SOURCES)
def stream_source_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of sources kept as keyed state."""
    return told(drained(spark, d, lambda e: live_ledger.ledger(ledger.source_effects(source_attempts(e)), missing=False), "update", ["unit"]))


@query(_ENTRANTS)
def stream_entrant_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of entrants' rounds kept as keyed state; timers at the deadlines tell what was missed."""
    return told(drained(spark, d, lambda e: live_ledger.ledger(ledger.entrant_effects(entrant_events(e)), missing=True), "update", ["unit"]))
