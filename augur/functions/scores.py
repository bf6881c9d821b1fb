"""Proper scores and losses as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from augur.functions.special import normal_cdf, normal_pdf, normal_quantile

#: The levels at which distributions are pooled: 0.025 to 0.975.
LEVELS = [i / 40 for i in range(1, 40)]


def crps_normal(mean: Column, sd: Column, outcome: Column) -> Column:
    """CRPS of a normal; with no spread it is the absolute error."""
    z = (outcome - mean) / sd
    return F.when(sd <= 0, F.abs(outcome - mean)).otherwise(sd * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi)))


def pinball(level: Column, q: Column, outcome: Column) -> Column:
    return F.when(outcome >= q, level * (outcome - q)).otherwise((1 - level) * (q - outcome))


def sorted_quantiles(quantiles: Column) -> Column:
    """map<string, double> as an array of (level, value) by level."""
    return F.array_sort(F.transform(F.map_entries(quantiles), lambda e: F.struct(e["key"].cast("double").alias("level"), e["value"].alias("value"))))


def crps_quantiles(quantiles: Column, outcome: Column) -> Column:
    """Twice the mean pinball loss over the levels that were given."""
    items = sorted_quantiles(quantiles)
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + 2 * pinball(e["level"], e["value"], outcome)) / F.size(items)


def interpolated(items: Column, level: Column) -> Column:
    """The value at a level, linear between the given ones and constant beyond them. items: as sorted_quantiles gives them."""
    below, above = F.filter(items, lambda e: e["level"] <= level), F.filter(items, lambda e: e["level"] >= level)
    low, high = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    share = F.when(high["level"] > low["level"], (level - low["level"]) / (high["level"] - low["level"])).otherwise(0.0)
    return F.when(low.isNull(), high["value"]).when(high.isNull(), low["value"]).otherwise(low["value"] + share * (high["value"] - low["value"]))


def crps_forecast(topline: Column, outcome: Column) -> Column:
    """Score of a number answer: its quantiles if it has any, else its normal."""
    return F.when(F.size(topline["quantiles"]) > 0, crps_quantiles(topline["quantiles"], outcome)).otherwise(crps_normal(topline["mean"], topline["sd"], outcome))


def pooled_values(topline: Column) -> Column:
    """The values of an answer at the 39 LEVELS."""
    items = sorted_quantiles(topline["quantiles"])
    levels = F.array(*[F.lit(x) for x in LEVELS])
    return F.when(F.size(topline["quantiles"]) > 0, F.transform(levels, lambda lv: interpolated(items, lv))).otherwise(F.transform(levels, lambda lv: normal_quantile(topline["mean"], topline["sd"], lv)))


def crps_samples(samples: Column, outcome: Column) -> Column:
    """CRPS of a set of draws: the mean distance to the outcome less half the mean distance of all pairs, itself included."""
    n, ordered = F.size(samples), F.array_sort(samples)
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("acc"), F.lit(0.0).alias("run"))
    pairs = F.aggregate(ordered, start, lambda s, x: F.struct((s["i"] + 1).alias("i"), (s["acc"] + x * s["i"] - s["run"]).alias("acc"), (s["run"] + x).alias("run")), lambda s: s["acc"])
    error = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + F.abs(x - outcome))
    return error / n - pairs / (n.cast("double") * n)


def rps(probabilities: Column, outcome: Column) -> Column:
    """Ranked probability score over ordered bins; outcome: index of the bin that came true, from 0."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("cum"), F.lit(0.0).alias("total"))

    def step(s: Column, p: Column) -> Column:
        cum = s["cum"] + p
        miss = cum - F.when(s["i"] >= outcome, 1.0).otherwise(0.0)
        return F.struct((s["i"] + 1).alias("i"), cum.alias("cum"), (s["total"] + miss * miss).alias("total"))

    return F.aggregate(probabilities, start, step, lambda s: s["total"]) / F.greatest(F.size(probabilities) - 1, F.lit(1))


def skill(loss: Column, null_loss: Column) -> Column:
    """The share of the null's loss that is removed; zero where the null has none."""
    return F.when(null_loss == 0, F.lit(0.0)).otherwise(1 - loss / null_loss)


def arena_score(loss: Column, null_loss: Column, noise: Column) -> Column:
    """0 for the null's loss, 100 for what noise alone would leave; NaN where noise leaves no room."""
    room = null_loss - noise / math.sqrt(math.pi)
    return F.when(room <= 0, F.lit(float("nan"))).otherwise(100 * (null_loss - loss) / room)


def rbo(predicted: Column, truth: Column, p: float, depth: Column) -> Column:
    """Rank-biased overlap of two lists cut at a depth, normalised by the weights used."""
    weight = lambda d: F.pow(F.lit(p), d - 1) * (1 - p)
    depths = F.sequence(F.lit(1), depth)
    agree = F.aggregate(depths, F.lit(0.0), lambda acc, d: acc + weight(d) * F.size(F.array_intersect(F.slice(predicted, F.lit(1), d), F.slice(truth, F.lit(1), d))) / d)
    return agree / F.aggregate(depths, F.lit(0.0), lambda acc, d: acc + weight(d))


def kendall_loss(predicted: Column, truth: Column) -> Column:
    """Discordant pairs over all pairs; refuses lists that are no permutations of one set of two items or more."""
    n = F.size(truth)
    ranks = F.transform(predicted, lambda x: F.array_position(truth, x))
    discordant = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda acc, i: acc + F.size(F.filter(F.slice(ranks, i + 1, n), lambda r: r < F.get(ranks, (i - 1).cast("int")))))
    fits = (n >= 2) & (F.array_sort(predicted) == F.array_sort(truth))
    return F.when(fits, discordant / (n * (n - 1) / 2)).otherwise(F.raise_error(F.lit("Kendall distance needs two permutations of one set of two items or more")).cast("double"))


def exact_positions(predicted: Column, truth: Column) -> Column:
    return F.size(F.filter(F.zip_with(predicted, truth, lambda a, b: a == b), lambda same: same))


def zero_one_loss(answer: Column, outcome: Column) -> Column:
    plain = lambda c: F.lower(F.trim(c))
    return F.when(plain(answer) == plain(outcome), 0.0).otherwise(1.0)


def rmse(answers: Column, outcomes: Column) -> Column:
    """Root of the mean squared difference of two arrays."""
    squares = F.zip_with(answers, outcomes, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(outcomes))
