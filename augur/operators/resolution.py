"""Resolving questions: what was frozen, what came first after it, and who may claim it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.operators.asof import earliest, last_rows


def frozen_history(obs: DataFrame, rounds: DataFrame, keep: int = 60) -> DataFrame:
    """round_id, date, value: the last `keep` points dated before each round's freeze. rounds: round_id, series, freeze_date."""
    joined = rounds.select("round_id", "series", "freeze_date").join(obs, "series").where("date < freeze_date")
    return last_rows(joined, ["round_id"], "date", keep).select("round_id", "series", "date", "value")


def frozen_value(obs: DataFrame, rounds: DataFrame) -> DataFrame:
    """round_id, date, value of the last point before the freeze."""
    joined = rounds.select("round_id", "series", "freeze_date").join(obs, "series").where("date < freeze_date")
    return joined.groupBy("round_id").agg(F.max_by(F.struct("date", "value"), "date").alias("_r")).select("round_id", "_r.*")


def first_release(published: DataFrame, rounds: DataFrame, frozen: DataFrame) -> DataFrame:
    """round_id, observed_date, value: the first release that a round's frozen history did not contain, by date and value.

    A revision of the last frozen date is a release too, but any later date goes before it. Of a daily source no reading
    from before the lock counts. A round without frozen history or without a new release has no row.
    published: series, date, value. rounds: round_id, series, lock_day, daily. frozen: round_id, date, value.
    """
    last = frozen.groupBy("round_id").agg(F.max("date").alias("_last"))
    due = rounds.select("round_id", "series", "lock_day", "daily").join(last, "round_id")
    new = due.join(published, "series").where("date >= _last and (not daily or date >= lock_day)").join(frozen.select("round_id", "date", "value"), ["round_id", "date", "value"], "left_anti")
    return earliest(new.select("round_id", "date", "value", (F.col("date") <= F.col("_last")).alias("_old")), ["round_id"], "_old", "date", "value").select("round_id", F.col("date").alias("observed_date"), "value")


def one_claim(resolutions: DataFrame, prior: DataFrame) -> DataFrame:
    """Resolutions of which no two rest on one observation (series, observed_date): the first by season order holds; voided prior claims don't count."""
    order = W.partitionBy("series", "observed_date").orderBy("season_order", "round_id")
    open_ = resolutions.join(prior.where("not voided").select("series", "observed_date").distinct(), ["series", "observed_date"], "left_anti")
    return open_.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_prints(snapshots: DataFrame) -> DataFrame:
    """series, week_end, value, capture_day: the first capture of each complete week is final. snapshots: series, week_end, capture_day, value, partial."""
    return earliest(snapshots.where("not partial"), ["series", "week_end"], "capture_day").select("series", "week_end", "value", "capture_day")


def round_status(rounds: DataFrame, now: str) -> DataFrame:
    """rounds with status: resolved, open, locked or awaiting_resolution, in that order."""
    at = F.lit(now).cast("timestamp")
    return rounds.withColumn("status", F.when(F.col("resolved"), "resolved").when(F.col("lock_at") > at, "open").when(F.col("release_at") > at, "locked").otherwise("awaiting_resolution"))


def last_before_lock(versions: DataFrame) -> DataFrame:
    """entrant, round_id, version, received_at: the last version received before the lock. Late ones are out."""
    return versions.where("received_at < lock_at").groupBy("entrant", "round_id").agg(F.max_by(F.struct("version", "received_at"), F.struct("received_at", "version")).alias("_r")).select("entrant", "round_id", "_r.*")


def cell_outcomes(obs: DataFrame, rounds: DataFrame) -> DataFrame:
    """round_id, date, value: the last value at or before the release, which must not be older than the freeze.

    Of a source that publishes waves (rounds may have a boolean wave) it must fall in the seven days that end on the release.
    """
    wave = F.col("wave") if "wave" in rounds.columns else F.lit(False)
    joined = rounds.select("round_id", "series", "freeze_date", "release_date", wave.alias("_wave")).join(obs, "series").where("date <= release_date")
    found = joined.groupBy("round_id", "freeze_date", "release_date", "_wave").agg(F.max_by(F.struct("date", "value"), "date").alias("_r")).select("round_id", "freeze_date", "release_date", "_wave", "_r.*")
    return found.where("date >= freeze_date and (not _wave or date > date_sub(release_date, 7))").select("round_id", "date", "value")


def as_displayed(calendar: DataFrame, snapshots: DataFrame, points: DataFrame) -> DataFrame:
    """series, day, value: what the first capture from each day on shows for the smaller of its end and that day.

    calendar: series, day. snapshots: series, capture_day, end_date. points: series, capture_day, date, value.
    """
    from augur.operators.asof import asof_forward

    shown = asof_forward(calendar, snapshots, ["series"], "day", "capture_day", ["capture_day", "end_date"]).where("capture_day is not null")
    wanted = shown.withColumn("date", F.least("end_date", "day"))
    return wanted.join(points, ["series", "capture_day", "date"]).select("series", "day", "value")
