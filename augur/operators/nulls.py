"""Null forecasts and the walk-forward backtest. Windows per series; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.functions.special import published

#: Points before the first forecast, the look-backs, the constant spread of persistence and the floors.
WARMUP, TREND_POINTS, CLIMATE_POINTS, EWMA_STEPS, ALPHA, PERSISTENCE_SD, MIN_SD, CLAMP_DAYS = 8, 8, 24, 12, 0.4, 1.5, 1.0, 21

#: 0.6 to this power is below 1e-17.
EWMA_MEMORY = 80


def series_window() -> object:
    return W.partitionBy("series").orderBy("date")


def ewma_level(values: Column) -> Column:
    """A true fold: each value moves the level by ALPHA of what is left."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda m, v: ALPHA * v + (1 - ALPHA) * m)


def with_nulls(obs: DataFrame, places: int | None = 2) -> DataFrame:
    """obs (series, date, value) with the four nulls' mean and sd for each date, from what came before it.

    persistence_*, trend_*, ewma_*, climatology_*; all null on a series' first date. Published with `places` decimals.
    The level of ewma is a fold over the last EWMA_MEMORY points: what came before weighs less than a double can hold.
    """
    w = series_window()
    back = lambda k: w.rowsBetween(-k, -1)
    x, y = F.datediff("date", F.lit("1970-01-01")).cast("double"), F.col("value")
    obs = obs.withColumns({"_x": x, "n_before": F.row_number().over(w) - 1, "_last": F.lag("value").over(w), "_last_x": F.lag(x).over(w), "_step": F.abs(y - F.lag("value").over(w))})
    t = back(TREND_POINTS)
    n, mx, my = F.count("value").over(t), F.avg("_x").over(t), F.avg("value").over(t)
    obs = obs.withColumns({"_n": n, "_mx": mx, "_my": my, "_pts": F.collect_list(F.struct(F.col("_x").alias("x"), y.alias("y"))).over(t)})
    dx = lambda p: p["x"] - F.col("_mx")
    total = lambda f: F.aggregate("_pts", F.lit(0.0), lambda acc, p: acc + f(p))
    obs = obs.withColumn("_sxx", total(lambda p: dx(p) * dx(p))).withColumn("_slope", total(lambda p: dx(p) * (p["y"] - F.col("_my"))) / F.nullif("_sxx", F.lit(0.0)))
    miss = lambda p: p["y"] - (F.col("_my") + F.col("_slope") * dx(p))
    obs = obs.withColumn("_rse", F.sqrt(total(lambda p: miss(p) * miss(p)) / F.greatest(F.col("_n") - 2, F.lit(1))))
    fits, horizon = (F.col("_n") >= 3) & (F.col("_sxx") > 0), F.greatest(F.col("_x") - F.col("_last_x"), F.lit(0.0))
    target = F.least("_x", F.col("_last_x") + CLAMP_DAYS)
    obs = obs.withColumn("_past", F.collect_list("value").over(back(EWMA_MEMORY)))
    known = F.col("n_before") > 0
    spread = F.greatest(F.coalesce(F.avg("_step").over(w.rowsBetween(-EWMA_STEPS, -1)), F.lit(MIN_SD)), F.lit(MIN_SD))
    climate = back(CLIMATE_POINTS)
    found = {
        "persistence_mean": F.col("_last"), "persistence_sd": F.lit(PERSISTENCE_SD),
        "trend_mean": F.when(fits, F.col("_my") + F.col("_slope") * (target - F.col("_mx"))).otherwise(F.col("_last")),
        "trend_sd": F.when(fits, F.greatest(1.5 * F.col("_rse"), F.lit(MIN_SD)) * F.sqrt(1 + horizon / 30.0)).otherwise(F.lit(PERSISTENCE_SD)),
        "ewma_mean": ewma_level(F.col("_past")), "ewma_sd": spread,
        "climatology_mean": F.avg("value").over(climate), "climatology_sd": F.greatest(F.coalesce(F.stddev_samp("value").over(climate), F.lit(0.0)), F.lit(MIN_SD)),
    }
    done = obs.select("series", "date", "value", "n_before", *[F.when(known, published(c, places) if places is not None else c).alias(k) for k, c in found.items()])
    return done


BASELINES = ("persistence", "trend", "ewma", "climatology")


def long_nulls(wide: DataFrame) -> DataFrame:
    """A row for each series, date and null: entrant, mean, sd, outcome."""
    rows = F.array(*[F.struct(F.lit(b).alias("entrant"), F.col(f"{b}_mean").alias("mean"), F.col(f"{b}_sd").alias("sd")) for b in BASELINES])
    return wide.select("series", "date", F.col("value").alias("outcome"), "n_before", F.explode(rows).alias("f")).select("series", "date", "outcome", "n_before", "f.*")


def walk_forward(obs: DataFrame, since: Column | None = None) -> DataFrame:
    """Forecasts of every date after the warm-up; `since` cuts after the warm-up has been counted."""
    found = long_nulls(with_nulls(obs)).where(F.col("n_before") >= WARMUP).drop("n_before")
    return found if since is None else found.where(F.col("date") >= since)


def noise_floor(obs: DataFrame) -> DataFrame:
    """series, noise, movement: what lag-1 autocovariance of first differences tells; series with fewer than four points are skipped."""
    w = series_window()
    steps = obs.withColumn("d", F.col("value") - F.lag("value").over(w)).where("d is not null").withColumn("next", F.lead("d").over(w))
    means = steps.groupBy("series").agg(F.avg("d").alias("m"), F.count("d").alias("n")).where("n >= 3")
    c = steps.join(means, "series").groupBy("series", "n").agg((F.sum((F.col("d") - F.col("m")) * (F.col("d") - F.col("m")))).alias("var"), F.sum((F.col("d") - F.col("m")) * (F.col("next") - F.col("m"))).alias("cov"))
    var, cov = F.col("var") / F.col("n"), F.col("cov") / F.col("n")
    noise2 = F.least(F.greatest(-cov, F.lit(0.0)), var / 2)
    return c.select("series", F.sqrt(noise2).alias("noise"), F.sqrt(F.greatest(var - 2 * noise2, F.lit(0.0))).alias("movement"))


def step_sd(obs: DataFrame, steps: int = 24) -> DataFrame:
    """series, step_sd: sample deviation of the last steps."""
    w = series_window()
    moved = obs.withColumn("d", F.col("value") - F.lag("value").over(w)).withColumn("_n", F.row_number().over(W.partitionBy("series").orderBy(F.desc("date"))))
    return moved.where(F.col("_n") <= steps).groupBy("series").agg(F.stddev_samp("d").alias("step_sd"))


def weekly_movement(obs: DataFrame, lag: int = 7, points: int = 60) -> DataFrame:
    """series, movement: mean absolute change over `lag` points, of the last `points` points."""
    w = series_window()
    recent = obs.withColumn("_n", F.row_number().over(W.partitionBy("series").orderBy(F.desc("date")))).where(F.col("_n") <= points)
    return recent.withColumn("d", F.abs(F.col("value") - F.lag("value", lag).over(w))).groupBy("series").agg(F.avg("d").alias("movement"))


def signal_to_noise(obs: DataFrame, points: int = 260) -> DataFrame:
    """series, ratio, movement, noise of the last `points` points: movement over noise, infinite where there is no noise, 0 below four points.

    A series of polls is measured by its weekly average (operators.polls.weekly_series), which its rounds resolve by: give that as obs.
    """
    recent = obs.withColumn("_n", F.row_number().over(W.partitionBy("series").orderBy(F.desc("date")))).where(F.col("_n") <= points).drop("_n")
    counts = recent.where("value is not null").groupBy("series").agg(F.count("*").alias("_points"))
    found = counts.join(noise_floor(recent.where("value is not null")), "series", "left")
    few = (F.col("_points") < 4) | F.col("noise").isNull()
    ratio = F.when(few, 0.0).when(F.col("noise") == 0, F.lit(float("inf"))).otherwise(F.col("movement") / F.col("noise"))
    return found.select("series", ratio.alias("ratio"), F.when(few, 0.0).otherwise(F.col("movement")).alias("movement"), F.when(few, 0.0).otherwise(F.col("noise")).alias("noise"))
