"""The run ledger: what has happened to every source and every entrant's round, folded from events.

An event's effect is a handful of columns that depend on the event alone, so Catalyst computes it before anything is
shuffled: the state it leads to (null: none), whether it sets the error and the next retry, how it counts attempts, and what
the operator has to do. A ledger is the fold of effects in order. Attempts are counted by steps `max(least, attempts + more)`,
whose composition is of the same form; all else is the last event that sets it. So units with very many events are folded by
days first, and no window holds more than one unit's day. streaming.ledger folds the same effects as they come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.functions.text import error_text, terminal
from augur.operators.rules import STALE

#: Hours until the next retry, and what operators are told to do.
RETRY_HOURS = 6
WAIT_SOURCE, WAIT_ANSWER, WAIT_WORKER, NONE = "wait for the in-flight source attempt", "wait for the provider response", "wait for the filing worker", "none"
INSPECT = "inspect upstream freshness; do not resolve a new round until the source moves"
UNCHANGED = "retry now or hold affected rounds before the filing deadline; do not treat the unchanged body as a new release"
REPAIR = "repair source access or extraction; preserve the last valid vintage and do not resolve from a substituted source"
HOLD = "retry now or hold affected rounds before the filing deadline"
NEXT_REFRESH = "retry on the next refresh; preserve the last valid vintage"
RESTORE_NOW = "restore live access now or hold affected rounds before the deadline; the same-source archive is not a new release"
RESTORE = "restore live access; the validated same-source archive may support forecasts but is not evidence of a new release"
ARCHIVE_USED = "live attempt failed; same-source archive used"
MISS = "do not file late or create a scored mock; record the miss"
CREDENTIALS = "repair credentials/route, then retry before the deadline; do not create a scored mock"
TOO_LATE = "retry immediately before the deadline; the scheduled retry is too late"
KEEP_OTHERS = "retry on the next refresh; keep other entrants' successes"
CEILING, RAISE, LEAVE = "withheld by the per-run spend ceiling", "raise the spend ceiling or retry manually before the deadline", "leave queued for the next refresh; nearest deadlines run first"
NO_FORECAST, STANDBY = "no valid forecast existed at the filing deadline", "standby route preserved the forecast"

#: What an effect is, and what a ledger's row is.
EFFECT = "unit string, ts timestamp, seq bigint, deadline timestamp, state string, least int, more int, sets_error boolean, error string, sets_retry boolean, next_retry timestamp, action string, alert boolean, route string, evidence array<string>"
ROW = "unit string, state string, attempts int, last_error string, next_retry timestamp, required_action string, alert boolean, route string, evidence array<string>, deadline timestamp"


def cases(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    first, *rest = pairs
    return reduce(lambda acc, p: acc.when(p[0], lit(p[1])), rest, F.when(first[0], lit(first[1]))).otherwise(lit(otherwise))


def later() -> tuple[Column, Column]:
    """The next retry, and whether it comes too late."""
    retry = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(RETRY_HOURS))
    return retry, F.coalesce(retry >= F.col("deadline"), F.lit(False))


def effects(events: DataFrame, **columns: Column) -> DataFrame:
    given = lambda name: F.col(name) if name in events.columns else F.lit(None).cast("string")
    kinds = dict(c.split(" ") for c in EFFECT.split(", "))
    columns = {"unit": F.col("unit"), "ts": F.col("ts"), "seq": F.col("seq"), "deadline": F.col("deadline"), "route": given("route"), **columns}
    return events.select(*[columns[c].cast(kind).alias(c) for c, kind in kinds.items()])


def source_effects(events: DataFrame) -> DataFrame:
    """events: unit (a source), ts, seq, deadline (of the next filing, or null), event (started, succeeded, stale, failed, degraded), error, and route and evidence if there are any.

    succeeded with an unchanged body is `stale`. `degraded` is a live attempt that failed and was served from the same
    source's archive (evidence names it): never healthy, as the archive is no new release. A failure that tells of a source
    standing still is stale; one that no retry can mend is unresolvable; a retry that would come too late is a deadline risk.
    """
    e, (retry, risk) = F.col("event"), later()
    text = F.coalesce(error_text(F.col("error")), F.lit("unknown source failure"))
    still = reduce(lambda a, w: a | F.contains(F.lower(text), F.lit(w)), STALE, F.lit(False))
    dead, failed, degraded = terminal(F.col("error"), source=True) & ~still, e == "failed", e == "degraded"
    proof = F.col("evidence").cast("string") if "evidence" in events.columns else F.lit(None).cast("string")
    return effects(
        events,
        state=cases((e == "succeeded", "healthy"), (e == "stale", "stale"), (failed & dead, "unresolvable"), ((failed | degraded) & risk, "deadline_risk"), ((failed & still) | degraded, "stale"), (failed, "retryable_failure")),
        least=cases((e == "started", 0), otherwise=1), more=cases((e == "started", 1), otherwise=0), sets_error=e != "started", error=F.when(failed | degraded, text), sets_retry=e != "started", next_retry=F.when((failed & ~dead) | degraded, retry),
        action=cases((e == "started", WAIT_SOURCE), (e == "succeeded", NONE), (e == "stale", INSPECT), (failed & dead, REPAIR), (failed & still, F.when(risk, UNCHANGED).otherwise(INSPECT)), (failed, F.when(risk, HOLD).otherwise(NEXT_REFRESH)), otherwise=F.when(risk, RESTORE_NOW).otherwise(RESTORE)),
        alert=F.when(e != "started", e != "succeeded"), evidence=F.array_compact(F.array(proof, F.when(degraded, ARCHIVE_USED))),
    )


def entrant_effects(events: DataFrame) -> DataFrame:
    """events: unit (round and entrant), ts, seq, deadline, event (queued, started, deferred, succeeded, failed, withheld), error; and route, artifact, next_retry, action and terminal (boolean) if there are any.

    succeeded with an error is an answer by the standby route: two attempts at least, and told of. A failure at or after
    the deadline is a missed lock. Other events at or after the deadline change nothing, and are left out.
    """
    e, (retry, risk) = F.col("event"), later()
    given = lambda name, kind: F.col(name).cast(kind) if name in events.columns else F.lit(None).cast(kind)
    past = F.coalesce(F.col("ts") >= F.col("deadline"), F.lit(False))
    text, failed, won = error_text(F.col("error")), e == "failed", e == "succeeded"
    dead = F.coalesce(given("terminal", "boolean"), terminal(F.col("error")))
    asked = F.coalesce(given("action", "string"), F.when(e == "queued", WAIT_WORKER).otherwise(NONE))
    artifact = given("artifact", "string")
    return effects(
        events.where(~past | failed),
        state=cases((e == "queued", "queued"), (e == "started", "running"), (e == "deferred", "queued"), (won, "succeeded"), (failed & past, "missed_lock"), (failed & dead, "terminal_failure"), (failed, "retryable_failure"), (e == "withheld", "queued")),
        least=cases((failed, 1), (won & text.isNotNull(), 2), otherwise=0), more=cases((e == "started", 1), (e == "deferred", -1), otherwise=0),
        sets_error=won | failed | (e == "withheld"), error=cases((e == "withheld", CEILING), (failed, F.coalesce(text, F.lit("unknown entrant failure"))), (won, text)),
        sets_retry=F.lit(True), next_retry=cases((e.isin("queued", "deferred"), given("next_retry", "timestamp")), (e == "withheld", retry), (failed & ~past & ~dead, retry)),
        action=cases((e.isin("queued", "deferred"), asked), (e == "started", WAIT_ANSWER), (won, NONE), (failed & past, MISS), (failed & dead, CREDENTIALS), (failed, F.when(risk, TOO_LATE).otherwise(KEEP_OTHERS)), otherwise=F.when(risk, RAISE).otherwise(LEAVE)),
        alert=cases((e == "queued", F.lower(asked).rlike("withheld|raise")), (won, text.isNotNull()), (e.isin("started", "deferred"), False), otherwise=True),
        evidence=F.array_compact(F.array(F.when(won & artifact.isNotNull(), F.concat(F.lit("forecast="), artifact)), F.when(won & text.isNotNull(), STANDBY))),
    )


def folded(steps: DataFrame) -> DataFrame:
    """ROW of every unit: its effects in the order of ts and seq. The state before any that an event sets is retryable_failure."""
    order = F.struct("ts", "seq")
    day = steps.withColumn("_day", F.to_date("ts"))
    after = F.coalesce(F.sum("more").over(W.partitionBy("unit", "_day").orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = lambda value, when: F.max_by(value, F.when(when, order))
    struct = lambda when, *names: F.max_by(F.struct(F.lit(True).alias("_set"), *names), F.when(when, order))
    daily = day.withColumn("_after", after).groupBy("unit", "_day").agg(
        F.max(F.when(F.col("least") > 0, F.col("least") + F.col("_after")).otherwise(F.when(F.col("more") < 0, F.col("_after")))).alias("_least"), F.sum("more").alias("_more"), struct(F.col("state").isNotNull(), "state").alias("_state"), struct(F.col("sets_error"), "error").alias("_error"),
        struct(F.col("sets_retry"), "next_retry").alias("_retry"), last("action", F.lit(True)).alias("action"), struct(F.col("alert").isNotNull(), "alert").alias("_alert"), last("route", F.col("route").isNotNull()).alias("route"),
        F.flatten(F.collect_set("evidence")).alias("evidence"), F.max("deadline").alias("deadline"),
    )
    rest = F.coalesce(F.sum("_more").over(W.partitionBy("unit").orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    newest = lambda name, field: F.max_by(F.col(name)[field], F.when(F.col(name).isNotNull(), F.col("_day")))
    return daily.withColumn("_rest", rest).groupBy("unit").agg(
        F.coalesce(newest("_state", "state"), F.lit("retryable_failure")).alias("state"), F.greatest(F.sum("_more"), F.coalesce(F.max(F.col("_least") + F.col("_rest")), F.lit(0)), F.lit(0)).cast("int").alias("attempts"), newest("_error", "error").alias("last_error"), newest("_retry", "next_retry").alias("next_retry"),
        F.max_by("action", "_day").alias("required_action"), F.coalesce(newest("_alert", "alert"), F.lit(False)).alias("alert"), F.max_by("route", F.when(F.col("route").isNotNull(), F.col("_day"))).alias("route"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"), F.max("deadline").alias("deadline"),
    )


def missed(rows: DataFrame, now: str) -> DataFrame:
    """rows as they stand at now: what has not succeeded by its deadline has missed its lock."""
    gone = F.coalesce((F.col("deadline") <= F.lit(now).cast("timestamp")) & ~F.col("state").isin("succeeded", "missed_lock"), F.lit(False))
    own = {"state": "missed_lock", "last_error": NO_FORECAST, "next_retry": None, "required_action": MISS, "alert": True}
    return rows.withColumns({c: F.when(gone, F.lit(v)).otherwise(F.col(c)) for c, v in own.items()})


def report(rows: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """state, n, alerts: all states, those without a unit too."""
    every = rows.sparkSession.createDataFrame([(s,) for s in states], "state string")
    return every.join(rows.groupBy("state").agg(F.count("*").alias("n"), F.count_if("alert").alias("alerts")), "state", "left").fillna(0)


#: All states that a report may hold.
SOURCE_STATES = ("healthy", "retryable_failure", "stale", "deadline_risk", "unresolvable")
ENTRANT_STATES = ("queued", "running", "succeeded", "retryable_failure", "terminal_failure", "missed_lock")
