"""Quality classifier (2): Bradley-Terry pairwise ranking.

Every document has general surface measures of its whole text (lengths, repetition of words and lines, shares of
capitals, digits and signs, words without letters), all built-in expressions. Every labelled document is learned from:
each good one is preferred to each bad one, and logistic loss on the differences of their measures, over all these
pairs, gives each document a latent score, as in the Bradley-Terry model. The score's exact quantile at the share of bad
documents among all labelled ones is the threshold; a logistic slope around it turns the latent score into the range
0 to 1.

Pairs are never listed. A pair counts by the difference of its two latent scores, so sums over all pairs follow from
each class's sums at evenly spaced scores (nodes), STEP apart: a document counts at the four nodes around its score, by
the weights of cubic interpolation, which gives a pair's loss and its slopes to some 1e-7. A Newton round is two passes
over the labelled documents' measures; what comes to the driver depends on the range of the scores, not on the number
of documents.

Nulls: a null text counts as empty; an empty text has measures (zeros), and so a score. Labels that are null, or whose
doc_id is null, teach nothing; of several labels of one document the largest holds. Without two classes to compare,
all documents get the smoothed share of the one class. Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.util import save, shielded, table

#: A labelled document of the larger class weighs as much as this many pairs, whatever their number; weight of the L2 penalty; bound of a standardised measure.
PAIRS, PENALTY, CLIP = 8, 1.0, 5.0

#: Distance of two nodes, rounds of Newton's method at most, decimals that weights keep (sums in any order give the same model).
STEP, ROUNDS, DECIMALS = 1 / 16, 100, 6

MEASURES = ("log_words", "distinct", "upper", "symbols", "wordless", "word_length", "lines", "symbol_runs", "repeats", "digits", "short", "long_words", "line_words")


def measures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) without text, with m0, m1, ...: the MEASURES of each whole text."""
    text = F.coalesce("text", F.lit(""))
    words, lines = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), F.split(text, "\n")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    staged = docs.select(
        *[c for c in docs.columns if c != "text"], F.length(text).cast("double").alias("_n"), words.alias("_words"), (F.size(F.array_distinct(lines)) / F.size(lines)).alias("_lines"),
        count(r"\p{Lu}").alias("_upper"), count(r"[^\p{L}\p{N}\s]").alias("_symbols"), count(r"(?<!\S)[^\p{L}\s]+(?!\S)").alias("_wordless"), count(r"[^\p{L}\p{N}\s]{2,}").alias("_runs"), count(r"\p{N}").alias("_digits"), F.size(lines).cast("double").alias("_rows"),
    )
    w, chars = F.greatest(F.size("_words"), F.lit(1)).cast("double"), F.greatest("_n", F.lit(1.0))
    repeats = F.size(F.filter(F.zip_with(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))), F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))
    found = {
        "log_words": F.log1p(F.size("_words")), "distinct": F.log1p(F.size(F.array_distinct("_words"))) / F.log1p(w), "upper": F.col("_upper") / chars, "symbols": F.col("_symbols") / chars, "wordless": F.col("_wordless") / w,
        "word_length": F.col("_n") / w, "lines": F.col("_lines"), "symbol_runs": F.col("_runs") / w, "repeats": repeats / w, "digits": F.col("_digits") / chars, "short": 1 / (1 + w),
        "long_words": F.size(F.filter("_words", lambda x: F.length(x) > 14)) / w, "line_words": F.log1p(w / F.greatest("_rows", F.lit(1.0))),
    }
    return staged.select(*[c for c in docs.columns if c != "text"], *[found[m].alias(f"m{i}") for i, m in enumerate(MEASURES)])


@dataclasses.dataclass
class Ranking:
    """weights: of each standardised measure and of its square. score = 1 / (1 + exp(-slope * (latent - threshold)))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    constant: float | None = None

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([z, z * z], axis=1)

    def latent(self) -> Column:
        latent = F.lit(0.0)
        for i, (m, s) in enumerate(zip(self.mean.tolist(), self.scale.tolist(), strict=True)):
            z = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col(f"m{i}") - m) / s))
            latent = latent + z * (float(self.weights[i]) + z * float(self.weights[len(self.mean) + i]))
        return latent

    def score(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        return 1 / (1 + F.exp(-self.slope * (self.latent() - self.threshold)))


def newton(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic loss with an L2 penalty, without intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def total(rows: DataFrame, part: Callable[[Iterator[np.ndarray]], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """By key, the sum over all tasks of what part() yields for a task's rows, which it gets as matrices of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, values in part(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), key, np.int64)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["key", "i", "value"])

    sums = rows.mapInArrow(run, "key long, i int, value double").groupBy("key", "i").agg(F.sum("value").alias("value")).orderBy("key", "i").toArrow()
    keys, values = sums["key"].to_numpy(), sums["value"].to_numpy()
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return dict(zip(keys[starts].tolist(), np.split(values, starts[1:]), strict=True))


def around(latent: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first of the four nodes around each score, and the weights of all four in cubic interpolation."""
    first = np.floor(latent / STEP)
    t = latent / STEP - first
    return first.astype(np.int64) - 1, [-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]


def at_nodes(rank: Ranking) -> Callable[[Iterator[np.ndarray]], Iterator[tuple[int, np.ndarray]]]:
    """By 2 * node + class: the number of documents and the sum of their design at each node. Rows: label, measures."""

    def part(matrices: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        for rows in matrices:
            for label in (0, 1):
                z = rank.design(rows[rows[:, 0] == label, 1:])
                first, weights = around(z @ rank.weights)
                z = np.column_stack([np.ones(len(z)), z])
                for k, weight in enumerate(weights):
                    nodes, place = np.unique(first + k, return_inverse=True)
                    found = np.column_stack([np.bincount(place, weight * column, len(nodes)) for column in z.T])
                    for node, values in zip(nodes.tolist(), found, strict=True):
                        sums[2 * node + label] = sums.get(2 * node + label, 0.0) + values
        yield from sums.items()

    return part


def bends(rank: Ranking, low: int, curve: list[np.ndarray]) -> Callable[[Iterator[np.ndarray]], Iterator[tuple[int, np.ndarray]]]:
    """The sum of each document's squared design by its class's curve, which is given at the nodes from low on."""

    def part(matrices: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        square = np.zeros((len(rank.weights), len(rank.weights)))
        for rows in matrices:
            for label in (0, 1):
                z = rank.design(rows[rows[:, 0] == label, 1:])
                first, weights = around(z @ rank.weights)
                square += (z * sum(w * curve[label][first - low + k] for k, w in enumerate(weights))[:, None]).T @ z
        yield 0, square.ravel()

    return part


def over_pairs(sums: dict[int, np.ndarray], width: int) -> tuple[int, float, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Over all pairs of a good and a bad document: first node, loss, its gradient, what pairs add to its Hessian across the classes, curves for bends()."""
    low, high = min(sums) // 2, max(sums) // 2
    n = high - low + 1
    bad, good = (np.array([sums.get(2 * node + label, np.zeros(1 + width)) for node in range(low, high + 1)]) for label in (0, 1))
    gap = STEP * np.arange(1 - n, n)  # of a good document's score over a bad one's
    loss, miss = np.logaddexp(0, -gap), np.exp(-np.logaddexp(0, gap))
    bend = miss * (1 - miss)
    spread = lambda counts, kernel: np.convolve(counts, kernel)[n - 1 : 2 * n - 1]
    gradient = bad[:, 1:].T @ spread(good[:, 0], miss[::-1]) - good[:, 1:].T @ spread(bad[:, 0], miss)
    across = good[:, 1:].T @ np.column_stack([spread(column, bend) for column in bad[:, 1:].T])
    return low, float(good[:, 0] @ spread(bad[:, 0], loss)), gradient, -across - across.T, [spread(good[:, 0], bend), spread(bad[:, 0], bend)]


def preferences(rows: DataFrame, rank: Ranking, weight: float) -> np.ndarray:
    """Weights at which the loss of all pairs, each by weight, and the L2 penalty are least: Newton's method, with half a step where the loss grows."""
    best, held = math.inf, rank.weights
    for _ in range(ROUNDS):
        low, loss, gradient, across, curves = over_pairs(total(rows, at_nodes(rank)), len(held))
        loss = weight * loss + PENALTY / 2 * float(rank.weights @ rank.weights)
        if loss > best + 1e-6 * (1 + best):
            rank = dataclasses.replace(rank, weights=(held + rank.weights) / 2)
            continue
        best, held = loss, rank.weights
        hessian = weight * (across + total(rows, bends(rank, low, curves))[0].reshape(len(held), len(held))) + PENALTY * np.eye(len(held))
        step = np.linalg.solve(hessian, weight * gradient + PENALTY * held)
        rank = dataclasses.replace(rank, weights=held - step)
        if np.abs(step).max() < 0.1**DECIMALS / 10:
            return rank.weights
    return held


def quantile(values: DataFrame, name: str, n: int, share: float) -> float:
    """The exact quantile of a column of n numbers, between two neighbours by the line through them. Passes narrow the range that holds it."""
    rank = min(int(share * (n - 1)), n - 1)
    x, left = F.col(name), rank
    low, high = values.agg(F.min(x), F.max(x)).first()
    while low < high:
        stretch = F.least(F.floor((x - low) / ((high - low) / 1024)), F.lit(1023))
        for r in values.where(x.between(low, high)).groupBy(stretch.alias("stretch")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("stretch").collect():
            if left < r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    upto, above = values.agg(F.count_if(x <= low), F.min(F.when(x > low, x))).first()
    following = low if upto > rank + 1 or above is None else above
    return low + (following - low) * (share * (n - 1) - rank)


def steepness(values: DataFrame, threshold: float) -> float:
    """Slope of a logistic regression of label on latent - threshold over all rows (label, latent)."""
    slope = 0.0
    for _ in range(ROUNDS):

        def part(matrices: Iterator[np.ndarray], slope: float = slope) -> Iterator[tuple[int, np.ndarray]]:
            sums = np.zeros(2)
            for rows in matrices:
                x = rows[:, 1] - threshold
                p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
                sums += (x @ (p - rows[:, 0]), (x * x) @ (p * (1 - p)))
            yield 0, sums

        gradient, bend = total(values, part)[0]
        step = (gradient + 0.01 * slope) / (bend + 0.01)
        slope -= step
        if abs(step) < 1e-8:
            break
    return slope


def fit(rows: DataFrame) -> Ranking:
    """rows: label (0 or 1) and m0, m1, ... of all labelled documents; read many times, so it should be a saved table."""
    names = [f"m{i}" for i in range(len(MEASURES))]
    n, good, bad, *moments = rows.agg(F.count("*"), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), *[F.avg(m) for m in names], *[F.stddev_pop(m) for m in names]).first()
    digits = np.array([float(f"{v or 0.0:.9g}") for v in moments])
    rank = Ranking(digits[: len(names)], np.maximum(digits[len(names) :], 1e-9) if n else np.ones(len(names)), np.zeros(2 * len(names)), 0.0, 1.0)
    if not good or not bad:
        rank.constant = (good + 1) / (n + 2)
        return rank
    rank.weights = np.round(preferences(rows, rank, PAIRS * max(good, bad) / (good * bad)), DECIMALS)
    latents = save(rows.select("label", rank.latent().alias("latent")), "latents")
    rank.threshold = quantile(latents, "latent", n, bad / n)
    rank.slope = max(0.05, round(float(steepness(latents, rank.threshold)), DECIMALS))
    return rank


def learn(measured: DataFrame, labels: DataFrame) -> Ranking:
    """measured: doc_id and measures; labels: doc_id, label. Fits all labelled documents."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    return fit(save(measured.join(known, "doc_id").select("label", *[f"m{i}" for i in range(len(MEASURES))]), "labelled"))


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """docs: doc_id, text; labels: doc_id, label. Fits all labelled documents."""
    return learn(measures(docs.select("doc_id", "text")), labels)


def scored(measured: DataFrame, rank: Ranking) -> DataFrame:
    """measured with score and predicted in place of the measures."""
    out = measured.withColumn("score", rank.score())
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(*[f"m{i}" for i in range(len(MEASURES))])


@shielded("doc_id", "text")
def quality_scores(docs: DataFrame, rank: Ranking) -> DataFrame:
    """The columns of docs without text, score and predicted."""
    return scored(measures(docs), rank)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text; labels are learned but from rows whose crc32 of doc_id mod 3 is not 1. Texts are measured once. Edge cases as in the module's docstring."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    measured = save(measures(docs), "measures")
    rank = learn(measured, labels.where(third != 1).select("doc_id", F.col("quality").alias("label")))
    return scored(measured, rank).select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", "predicted")
