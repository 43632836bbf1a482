"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column) -> Column:
    """Complementary error function by Chebyshev's rational fit (error below 1.2e-7)."""
    # The published coefficients of the fit.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    z = F.abs(x)
    t = 1 / (1 + z / 2)
    poly = F.lit(c[-1])
    for a in reversed(c[:-1]):
        poly = a + t * poly
    out = t * F.exp(-z * z + poly)
    return F.when(x >= 0, out).otherwise(2 - out)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def student_two_sided(t: Column, df: Column, steps: int = 2000) -> Column:
    """P(|T| >= t): the density integrated by Simpson's rule over the angle atan(t / sqrt(df)).

    With u = sqrt(df) * tan(a) the density becomes cos(a)^(df-1) up to a constant, so both integrals are of one kind.
    """
    top = F.atan(F.abs(t) / F.sqrt(df))

    def integral(lo: Column, hi: Column) -> Column:
        h = (hi - lo) / steps
        w = lambda i: F.when((i == 0) | (i == steps), 1).when(i % 2 == 1, 4).otherwise(2)
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, i: a + w(i) * F.pow(F.greatest(F.cos(lo + h * i), F.lit(0.0)), df - 1)) * h / 3

    whole = integral(F.lit(0.0), F.lit(math.pi / 2))
    return integral(top, F.lit(math.pi / 2)) / whole
