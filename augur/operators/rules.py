"""Validation as queries that return what is wrong, and ordered gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails; 'ok' if none does. checks: (name, failing)."""
    return reduce(lambda acc, c: acc.when(c[1], c[0]), checks[1:], F.when(checks[0][1], checks[0][0])).otherwise("ok")


def violations(rows: DataFrame, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """key, problem: a row for each check that a row fails, in one pass."""
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(failing, name) for name, failing in checks]))).alias("problem"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def round_checks(hours: int = 48) -> list[tuple[str, Column]]:
    """What a round must satisfy. Columns: series, lock_at, release_at, rights."""
    gap = F.unix_timestamp("release_at") - F.unix_timestamp("lock_at")
    return [("missing_series", F.col("series").isNull()), ("reversed", gap <= 0), ("not_48h", (gap > 0) & (gap != hours * 3600)), ("weekend", F.weekday("release_at") >= 5), ("rights", F.coalesce(F.col("rights") != "open", F.lit(True)))]


def exact_set(asked: DataFrame, answered: DataFrame, key: list[str]) -> DataFrame:
    """key, problem: what was asked and not answered (missing) or answered and not asked (unexpected)."""
    a, b = asked.select(*key).distinct(), answered.select(*key).distinct()
    return a.exceptAll(b).withColumn("problem", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("unexpected")))


def at_least(level: Column, threshold: str, levels: list[str]) -> Column:
    """Whether an ordinal level reaches the threshold; unknown levels don't."""
    place = lambda c: F.array_position(F.lit(levels), c)
    return (place(level) > 0) & (place(level) >= place(F.lit(threshold)))


def verdicts(new: DataFrame, old: DataFrame, key: list[str], digest: str) -> DataFrame:
    """key, verdict: created, replaced or unchanged, and kept for what only the old side has."""
    joined = new.select(*key, F.col(digest).alias("_new")).join(old.select(*key, F.col(digest).alias("_old")), key, "full")
    return joined.select(*key, F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("replaced").alias("verdict"))


def job_still_due(now: str, least_minutes: int = 30, most_hours: int = 24) -> Column:
    """Whether a job is to be run: its lock is between half an hour and a day away, and it has not been answered."""
    left = F.unix_timestamp("lock_at") - F.unix_timestamp(F.lit(now).cast("timestamp"))
    return left.between(least_minutes * 60, most_hours * 3600) & F.col("answered_at").isNull()


def candidates(series: DataFrame, start: str, weeks: int) -> DataFrame:
    """series, round_id, lock_at, release_at of the rounds to come: one a week on each series' weekday, locked 48 hours before. series: series, weekday (0 is Monday)."""
    monday = F.date_trunc("week", F.lit(start).cast("timestamp"))
    weekly = series.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    release = monday + F.make_dt_interval(F.col("week") * 7 + F.col("weekday"), F.lit(12))
    dated = weekly.select("series", release.alias("release_at"), (release - F.make_dt_interval(F.lit(2))).alias("lock_at")).where(F.col("lock_at") > F.lit(start).cast("timestamp"))
    return dated.select("series", F.concat_ws("-", "series", F.date_format("release_at", "yyyy-MM-dd")).alias("round_id"), "lock_at", "release_at")


def schedule_slips(releases: DataFrame, keep: int = 8, expected_days: int = 7) -> DataFrame:
    """series, slips, seen: of the last `keep` steps between releases, how many were not as long as expected. releases: series, date."""
    from pyspark.sql import Window as W

    w = W.partitionBy("series").orderBy("date")
    steps = releases.withColumn("step", F.datediff("date", F.lag("date").over(w))).withColumn("_n", F.row_number().over(W.partitionBy("series").orderBy(F.desc("date"))))
    return steps.where((F.col("_n") <= keep) & F.col("step").isNotNull()).groupBy("series").agg(F.count_if(F.col("step") != expected_days).alias("slips"), F.count("*").alias("seen"))


def usable_from(models: DataFrame, margin_days: int = 30) -> DataFrame:
    """models (entrant, cutoff) with usable_from, and common_start: the day from which all of them can be compared."""
    own = models.withColumn("usable_from", F.date_add("cutoff", margin_days))
    return own.crossJoin(F.broadcast(own.agg(F.max("usable_from").alias("common_start"))))  # one row


def retries(failures: DataFrame, every_hours: int = 6) -> DataFrame:
    """failures (failed_at, deadline, any others) with next_retry and at_risk: whether the next retry comes too late."""
    following = F.col("failed_at") + F.make_dt_interval(F.lit(0), F.lit(every_hours))
    return failures.withColumn("next_retry", following).withColumn("at_risk", F.col("next_retry") >= F.col("deadline"))


#: Wordings of an error that tell of a source that stands still.
STALE = ("stale", "frozen page", "stopped moving", "unchanged for", "newest row is", "newest observation")


def source_state(ok: Column, stale: Column, error: Column, at: Column, deadline: Column) -> Column:
    """The state of a source after an attempt: healthy, stale, retryable_failure, deadline_risk or unresolvable.

    A failure whose next retry would come at or after the deadline is a risk, unless no retry can mend it. An error
    that tells of a source standing still is stale first of all.
    """
    from augur.functions.text import error_text, terminal

    text = F.lower(error_text(error))
    still = reduce(lambda a, w: a | F.contains(text, F.lit(w)), STALE, F.lit(False))
    risk = F.coalesce(at + F.make_dt_interval(F.lit(0), F.lit(6)) >= deadline, F.lit(False))
    return (
        F.when(ok & stale, "stale").when(ok, "healthy").when(still, F.when(risk, "deadline_risk").otherwise("stale")).when(terminal(error, source=True), "unresolvable")
        .when(risk, "deadline_risk").otherwise("retryable_failure")
    )


def still_due(now: str, least_minutes: int = 720) -> Column:
    """Whether an answer is still to be bought: one that isn't there, whenever; one filed within the window, never; a draft from before the window, until half the window before the lock.

    Columns: filed (whether there is one), in_window, lock_at.
    """
    left = F.unix_timestamp("lock_at") - F.unix_timestamp(F.lit(now).cast("timestamp"))
    return F.when(~F.col("filed"), F.lit(True)).when(F.col("in_window"), F.lit(False)).otherwise(left >= least_minutes * 60)
