"""Special functions as Column expressions: everything stays in the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Acklam's rational approximation of the normal quantile, central and tail.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


#: Cody's rational approximations of the error function (1969), numerators and denominators from the highest power on: of erf up to NEAR, of erfc up to FAR, and beyond.
NEAR, FAR = 0.46875, 4.0
ERF_P, ERF_Q = (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03), (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
MID_P = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03)
MID_Q = (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
TAIL_P, TAIL_Q = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def erf(x: Column) -> Column:
    """The error function, to about 1e-16, by rational functions: plain arithmetic, which Catalyst compiles."""
    a = F.abs(x)
    b = F.greatest(a, F.lit(NEAR))
    inverse = 1 / (b * b)
    tail = F.exp(-b * b) / b * (1 / math.sqrt(math.pi) - inverse * horner(TAIL_P, inverse) / horner(TAIL_Q, inverse))
    middle = F.exp(-b * b) * horner(MID_P, b) / horner(MID_Q, b)
    return F.when(a <= NEAR, x * horner(ERF_P, x * x) / horner(ERF_Q, x * x)).otherwise(F.signum(x) * (1 - F.when(a <= FAR, middle).when(a < 6, tail).otherwise(0.0)))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def normal_quantile(mean: Column, sd: Column, level: Column) -> Column:
    """The inverse distribution function of a normal, by three branches of rational functions."""
    p = F.least(F.greatest(level, F.lit(1e-9)), F.lit(1 - 1e-9))
    tail = lambda q: horner(ACKLAM_C, q) / horner(ACKLAM_D, q)
    mid = p - 0.5
    z = F.when(p < TAIL, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - TAIL, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(horner(ACKLAM_A, mid * mid) * mid / horner(ACKLAM_B, mid * mid))
    return mean + sd * z


def published(x: Column, places: int) -> Column:
    """x rounded half to even for publication. Sums of binary fractions differ from exact decimals below 1e-12 only."""
    return F.bround(x, places)
