"""The crowd's forecast: an equal mixture of the members' distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.functions.scores import LEVELS, pooled_values

MEMBERS, LEAST_SD = 2, 1e-6


def pooled_samples(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """by, members, samples: the members' values at the fixed levels, together. forecasts: by, entrant, topline."""
    return forecasts.groupBy(*by).agg(F.count("*").alias("members"), F.flatten(F.collect_list(pooled_values(F.col("topline")))).alias("samples")).where(F.col("members") >= MEMBERS)


def crowd_numbers(forecasts: DataFrame, by: list[str], places: int | None = 4) -> DataFrame:
    """by, members, mean, sd (population) and quantiles (map of level to value), published to `places` decimals, of two members at least."""
    published = lambda c: c if places is None else F.bround(c, places)
    values = forecasts.select(*by, "entrant", F.explode(pooled_values(F.col("topline"))).alias("x"))
    levels = F.array(*[F.lit(x) for x in LEVELS])
    pooled = values.groupBy(*by).agg(F.countDistinct("entrant").alias("members"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.percentile("x", levels).alias("_q")).where(F.col("members") >= MEMBERS)
    names = F.array(*[F.lit(f"{x:g}") for x in LEVELS])
    return pooled.select(*by, "members", published(F.col("mean")).alias("mean"), F.greatest(published(F.col("sd")), F.lit(LEAST_SD)).alias("sd"), F.map_from_arrays(names, F.transform("_q", published)).alias("quantiles"))


def crowd_profiles(forecasts: DataFrame, by: list[str], cells: list[str], places: int | None = 4) -> DataFrame:
    """by, cell and the crowd's numbers of each cell, pooled cell by cell from the members whose profiles are complete: of two such members at least.

    forecasts: by, entrant, profile (a map of cell to mean, sd, quantiles). A profile is complete if every cell has
    quantiles, or a mean and a positive sd; cells beyond the round's are not read.
    """
    named = F.lit(cells)
    answer = lambda c: F.try_element_at("profile", c)
    fine = lambda c: (F.coalesce(F.size(answer(c)["quantiles"]), F.lit(0)) > 0) | F.coalesce(answer(c)["mean"].isNotNull() & (answer(c)["sd"] > 0), F.lit(False))
    whole = forecasts.where(F.forall(named, fine))
    each = whole.select(*by, "entrant", F.explode(F.transform(named, lambda c: F.struct(c.alias("cell"), answer(c).alias("topline")))).alias("c")).select(*by, "entrant", "c.*")
    return crowd_numbers(each, [*by, "cell"], places)


def crps_of_draws(draws: DataFrame, outcomes: DataFrame, by: list[str]) -> DataFrame:
    """by, crps of any number of draws a key: the mean distance to the outcome less half the mean distance of all pairs. draws: by, x. outcomes: by, value.

    With the draws in order, the distances of pairs are a sum of places times values, so a sorted window is enough.
    """
    order, every = W.partitionBy(*by).orderBy("x"), W.partitionBy(*by)
    placed = draws.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(every)}).join(outcomes.select(*by, "value"), by)
    return placed.groupBy(*by).agg((F.avg(F.abs(F.col("x") - F.col("value"))) - F.sum(F.col("x") * (2 * F.col("_i") - F.col("_n") - 1)) / (F.first("_n").cast("double") * F.first("_n"))).alias("crps"))
