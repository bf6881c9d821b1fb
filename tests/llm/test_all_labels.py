"""Quality (2): every labelled document teaches, against loss over all pairs listed one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from augur.llm import quality
from tests.llm.test_edges import docs, prose


def test_every_label_counts(spark):
    """More labels than any sample was: the share of the one class is that of all."""
    n = 20_500
    many = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    assert quality.train(many, many.select("doc_id", F.lit(1).alias("label"))).constant == (n + 1) / (n + 2)


def all_pairs(x, y):
    """Weights, threshold and slope by Newton's method on a list of all pairs."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.clip((x - mean) / scale, -quality.CLIP, quality.CLIP)
    z = np.concatenate([z, z * z], axis=1)
    good, bad = z[y == 1], z[y == 0]
    gaps = (good[:, None, :] - bad[None, :, :]).reshape(-1, z.shape[1])
    weight, w = quality.PAIRS * max(len(good), len(bad)) / len(gaps), np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(gaps @ w))
        w -= np.linalg.solve(weight * (gaps * (p * (1 - p))[:, None]).T @ gaps + quality.PENALTY * np.eye(len(w)), -weight * gaps.T @ p + quality.PENALTY * w)
    latent = z @ w
    threshold = np.quantile(latent, len(bad) / len(y))
    return w, threshold, max(0.05, float(quality.newton((latent - threshold)[:, None], y.astype(float), 0.01)[0]))


@pytest.mark.parametrize("mixed", [0.0, 0.2])
def test_all_pairs(spark, mixed):
    rnd = random.Random(9)
    data = [(i, prose(rnd, rnd.randrange(5, 60)) if i % 3 else " ".join(w.upper() + "!!" * (rnd.random() < 0.5) for w in prose(rnd, rnd.randrange(5, 40)).split()), "s") for i in range(160)]
    d = docs(spark, data).repartition(4)
    labels = [(i, int((i % 3 > 0) != (rnd.random() < mixed))) for i in range(150)]
    rank = quality.train(d, spark.createDataFrame(labels, "doc_id long, label int"))
    found = {r[0]: r[1:] for r in quality.measures(d.select("doc_id", "text")).collect()}
    w, threshold, slope = all_pairs(np.array([found[i] for i, _ in labels]), np.array([y for _, y in labels]))
    assert rank.weights == pytest.approx(w, abs=1e-5) and rank.threshold == pytest.approx(threshold, abs=1e-4) and rank.slope == pytest.approx(slope, rel=1e-3)


def test_quantile(spark):
    rnd = random.Random(10)
    for values in ([3.0], [1.0, 1.0, 1.0], [rnd.gauss(0, 1) for _ in range(501)], [float(rnd.randrange(5)) for _ in range(200)], [1.0, 1.0 + 2**-52, 1e9, -1e9]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for share in (0.0, 0.1, 0.5, 0.77, 1.0):
            assert quality.quantile(df, "x", len(values), share) == pytest.approx(np.quantile(values, share), rel=1e-12, abs=1e-12)
