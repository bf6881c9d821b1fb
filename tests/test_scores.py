"""Scores by hand-computed constants, identities and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from augur.functions import scores as S
from augur.functions.special import erf, normal_quantile


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(float(x))


def test_erf(spark):
    found = spark.range(-70, 71).select("id", erf(F.col("id") / 10.0).alias("x")).collect()
    assert all(abs(r["x"] - math.erf(r["id"] / 10)) < 1e-14 for r in found)


def test_crps_of_a_normal(spark):
    assert one(spark, S.crps_normal(lit(0), lit(1), lit(0))) == pytest.approx(0.23370, abs=1e-5)
    assert one(spark, S.crps_normal(lit(0), lit(2), lit(0))) == pytest.approx(0.46739, abs=1e-5)
    assert one(spark, S.crps_normal(lit(1), lit(0), lit(4))) == 3.0


def test_quantiles_agree_with_the_normal(spark):
    q = F.map_from_arrays(F.array(*[F.lit(f"{x:g}") for x in S.LEVELS]), F.array(*[normal_quantile(lit(1), lit(2), F.lit(x)) for x in S.LEVELS]))
    assert one(spark, S.crps_quantiles(q, lit(2.5))) == pytest.approx(one(spark, S.crps_normal(lit(1), lit(2), lit(2.5))), rel=0.05)
    assert one(spark, normal_quantile(lit(0), lit(1), lit(0.975))) == pytest.approx(1.959964, abs=1e-6)


def test_interpolation(spark):
    items = S.sorted_quantiles(F.map_from_arrays(F.array(F.lit("0.5"), F.lit("0.1")), F.array(lit(10), lit(2))))
    assert [one(spark, S.interpolated(items, lit(x))) for x in (0.05, 0.1, 0.3, 0.5, 0.9)] == pytest.approx([2, 2, 6, 10, 10])


def test_crps_of_samples(spark):
    rnd = random.Random(1)
    xs = [rnd.gauss(0, 1) for _ in range(50)]
    brute = sum(abs(x - 0.3) for x in xs) / 50 - 0.5 * sum(abs(a - b) for a in xs for b in xs) / 2500
    assert one(spark, S.crps_samples(F.array(*map(lit, xs)), lit(0.3))) == pytest.approx(brute, abs=1e-12)


def test_rps_and_skill(spark):
    third = F.array(*[lit(1 / 3)] * 3)
    assert one(spark, S.rps(third, F.lit(1))) == pytest.approx((1 / 9 + 1 / 9) / 2)
    assert [one(spark, S.skill(lit(a), lit(b))) for a, b in ((1, 2), (2, 2), (4, 2), (1, 0))] == [0.5, 0.0, -1.0, 0.0]
    assert one(spark, S.arena_score(lit(2), lit(2), lit(0.5))) == 0 and one(spark, S.arena_score(lit(0.5 / math.sqrt(math.pi)), lit(2), lit(0.5))) == pytest.approx(100)
    assert math.isnan(one(spark, S.arena_score(lit(2), lit(0.1), lit(9))))


def rbo(a, b, p, depth):
    weight = [(1 - p) * p**d for d in range(depth)]
    return sum(w * len(set(a[: d + 1]) & set(b[: d + 1])) / (d + 1) for d, w in enumerate(weight)) / sum(weight)


def test_rbo(spark):
    letters = lambda s: F.array(*[F.lit(c) for c in s])
    assert one(spark, S.rbo(letters("ACB"), letters("ABC"), 0.9, F.lit(3))) == pytest.approx(0.834, abs=5e-4)
    rnd = random.Random(2)
    for p in (0.5, 0.9, 0.98):
        a, b = rnd.sample("abcdefghijkl", 8), rnd.sample("abcdefghijkl", 8)
        assert one(spark, S.rbo(letters(a), letters(b), p, F.lit(8))) == pytest.approx(rbo(a, b, p, 8), abs=1e-12)


def test_kendall(spark):
    letters = lambda s: F.array(*[F.lit(c) for c in s])
    assert [one(spark, S.kendall_loss(letters(a), letters("ABCDE"))) for a in ("ABCDE", "EDCBA", "BACDE", "ABCED")] == pytest.approx([0, 1, 0.1, 0.1])
    with pytest.raises(Exception, match="permutations"):
        one(spark, S.kendall_loss(letters("ABX"), letters("ABC")))


def test_point_losses(spark):
    assert one(spark, S.rmse(F.array(lit(0), lit(0)), F.array(lit(3), lit(4)))) == pytest.approx(math.sqrt(12.5))
    assert one(spark, S.zero_one_loss(F.lit(" Yes "), F.lit("yes"))) == 0.0
