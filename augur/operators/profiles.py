"""Profiles: vectors of cells answered with a normal each, scored jointly.

Draws are a Latin hypercube: each cell takes its 400 levels in an order that a hash fixes, so scores are the same in
every run and on every cluster. The order of a cell is one small table; forecasts are rows with arrays, so nothing is
exploded into pairs: the pair term runs inside a row, in numpy batches for full draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.functions.scores import crps_normal, crps_samples
from augur.functions.special import normal_quantile

#: Draws of a profile, and the seed of their order.
DRAWS, SEED = 400, 20260811

#: Profiles whose pairs a task holds at once, and those it gets in all.
AT_ONCE, TASK_PROFILES = 16, 128


def permutations(spark: SparkSession, cells: int, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """cell, levels: for each cell the levels (i + 1/2) / draws, ordered by the SHA-256 of seed:cell:i."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.struct(F.sha2(F.concat_ws(":", F.lit(seed), F.col("cell"), i), 256).alias("h"), i.alias("i")))
    order = F.transform(F.array_sort(keys), lambda k: (k["i"] + 0.5) / draws)
    return spark.range(cells).select(F.col("id").cast("int").alias("cell")).select("cell", order.alias("levels"))


def spread(cells: DataFrame) -> DataFrame:
    """cells, refusing a spread that isn't positive."""
    return cells.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.raise_error(F.lit("a spread must be positive")).cast("double")))


def cell_samples(cells: DataFrame, draws: int = DRAWS) -> DataFrame:
    """cells (cell, mean, sd, any others) with samples, an array of draws. Refuses a spread that isn't positive."""
    spark = cells.sparkSession
    count = (cells.agg(F.max("cell")).first()[0] or 0) + 1  # cells of a profile: a fixed, small number
    sampled = spread(cells).join(F.broadcast(permutations(spark, count, draws)), "cell")
    return sampled.withColumn("samples", F.transform("levels", lambda p: normal_quantile(F.col("mean"), F.col("sd"), p))).drop("levels")


def vectors(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, samples (an array of draws for each cell, in order of cells), outcome (an array). cells: by, cell, samples, outcome."""
    rows = F.array_sort(F.collect_list(F.struct("cell", "samples", "outcome")))
    return cells.groupBy(*by).agg(rows.alias("_r")).select(*by, F.col("_r.samples").alias("samples"), F.col("_r.outcome").alias("outcome"))


def energy(samples: np.ndarray, outcome: np.ndarray) -> float:
    """samples: cells by draws. Mean distance to the outcome less half the mean distance of all pairs."""
    x = samples.T
    square = (x * x).sum(1)
    pairs = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    return float(np.sqrt(((x - outcome) ** 2).sum(1)).mean() - pairs.sum() / (2 * len(x) ** 2))


def with_energy(profiles: DataFrame) -> DataFrame:
    """profiles (samples, outcome, any others) with energy and structure (the energy of what is left without each draw's mean)."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = [np.stack(s) for s in frame["samples"]]
            y = [np.asarray(o, dtype=float) for o in frame["outcome"]]
            yield frame.assign(energy=[energy(a, b) for a, b in zip(x, y, strict=True)], structure=[energy(a - a.mean(0), b - b.mean()) for a, b in zip(x, y, strict=True)])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in profiles.schema], "energy double", "structure double"])
    return profiles.mapInPandas(score, schema)


def joint(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """energy, structure and level of each profile. x: profiles by draws by cells, y: profiles by cells.

    One Gram matrix a profile gives all pairs of draws; without each draw's mean their squared distances are less by the
    cells times the squared difference of the means, so the structure's pairs need no second one.
    """
    n, cells = x.shape[1], x.shape[2]
    means, own = x.mean(2), y.mean(1)
    square = np.einsum("pdc,pdc->pd", x, x)
    pairs = square[:, :, None] + square[:, None, :]
    pairs -= 2 * (x @ x.transpose(0, 2, 1))
    np.maximum(pairs, 0, out=pairs)
    gaps = means[:, :, None] - means[:, None, :]
    gaps *= gaps
    shape = pairs - cells * gaps
    np.maximum(shape, 0, out=shape)
    spread_of = lambda d: np.sqrt(d, out=d).sum((1, 2)) / (2 * n * n)
    error = lambda d: np.sqrt((d * d).sum(2)).mean(1)
    ordered = np.sort(means, axis=1)
    level = np.abs(means - own[:, None]).mean(1) - (ordered * (2 * np.arange(n) - n + 1)).sum(1) / n**2
    return np.stack([error(x - y[:, None, :]) - spread_of(pairs), error(x - means[:, :, None] - (y - own[:, None])[:, None, :]) - spread_of(shape), level], axis=1)


def joint_scores(cells: DataFrame, by: list[str], draws: int = DRAWS) -> DataFrame:
    """by, energy, structure, level: as with_energy and level_score of the cells' samples, which are drawn in batches of profiles and never shuffled.

    cells: by, cell, mean, sd, outcome. The orders of the cells (cells of a profile by draws) are all that reaches the driver.
    Profiles are few bytes and much work, so they are dealt out by their number, not by their size.
    """
    size = cells.agg(F.max("cell").alias("most"), F.count("*").alias("rows")).first()
    count = (size["most"] or 0) + 1  # cells of a profile: a fixed, small number
    order = permutations(cells.sparkSession, count, draws).select("cell", F.transform("levels", lambda p: normal_quantile(F.lit(0.0), F.lit(1.0), p)).alias("z"))
    z = np.array([r["z"] for r in order.orderBy("cell").collect()])
    rows = F.array_sort(F.collect_list(F.struct("cell", "mean", "sd", "outcome")))
    dealt = spread(cells).repartition(max(1, min(100_000, size["rows"] // (count * TASK_PROFILES) + 1)), *by)
    profiles = dealt.groupBy(*by).agg(rows.alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(f"_{c}") for c in ("cell", "mean", "sd", "outcome")])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.empty((len(frame), 3))
            shapes: dict[bytes, list[int]] = {}
            for i, cell in enumerate(frame["_cell"]):  # profiles of the same cells go together
                shapes.setdefault(np.asarray(cell).tobytes(), []).append(i)
            column = {c: frame[c].to_numpy() for c in ("_cell", "_mean", "_sd", "_outcome")}
            for rows in shapes.values():
                levels = z[column["_cell"][rows[0]]].T
                for i in range(0, len(rows), AT_ONCE):
                    at = rows[i : i + AT_ONCE]
                    mean, sd, y = (np.stack(column[c][at]) for c in ("_mean", "_sd", "_outcome"))
                    out[at] = joint(mean[:, None, :] + sd[:, None, :] * levels, y)
            yield frame[by].assign(energy=out[:, 0], structure=out[:, 1], level=out[:, 2])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in profiles.select(*by).schema], "energy double", "structure double", "level double"])
    return profiles.mapInPandas(score, schema)


def energy_native(samples: Column, outcome: Column) -> Column:
    """The energy score as an expression, for few draws: pairs of draws are folded in place, not joined."""
    draws, cells = F.size(F.get(samples, F.lit(0))), F.size(samples)
    at = lambda c, i: F.get(F.get(samples, (c - 1).cast("int")), (i - 1).cast("int"))
    norm = lambda f: F.sqrt(F.aggregate(F.sequence(F.lit(1), cells), F.lit(0.0), lambda acc, c: acc + f(c) * f(c)))
    each = F.sequence(F.lit(1), draws)
    error = F.aggregate(each, F.lit(0.0), lambda acc, i: acc + norm(lambda c: at(c, i) - F.get(outcome, (c - 1).cast("int"))))
    pairs = F.aggregate(each, F.lit(0.0), lambda acc, i: acc + F.aggregate(each, F.lit(0.0), lambda inner, j: inner + norm(lambda c: at(c, i) - at(c, j))))
    return error / draws - pairs / (2 * draws.cast("double") * draws)


def level_score(samples: Column, outcome: Column) -> Column:
    """CRPS of the mean over the cells."""
    cells = F.size(samples)
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / cells
    draws = F.transform(F.sequence(F.lit(0), F.size(F.get(samples, F.lit(0))) - 1), lambda i: mean(F.transform(samples, lambda s: F.get(s, i))))
    return crps_samples(draws, mean(outcome))


def cell_scores(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, mean_cell_crps, cells: the mean CRPS over the cells, each as a normal."""
    return cells.groupBy(*by).agg(F.avg(crps_normal(F.col("mean"), F.col("sd"), F.col("outcome"))).alias("mean_cell_crps"), F.count("*").alias("cells"))
