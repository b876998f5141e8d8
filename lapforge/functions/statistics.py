"""Significance in column expressions: log-gamma, the regularised incomplete beta function, Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients of the gamma function for g = 7, nine terms.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of a half and more."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + c / (x + i)
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, good for x below (a + 1) / (a + b + 2).

    Its number of terms grows with the root of the larger parameter; terms after convergence change nothing.
    """
    away = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    d0 = 1 / away(1 - (a + b) * x / (a + 1))

    def term(s: Column, value: Column) -> Column:
        d = 1 / away(1 + value * s["d"])
        c = away(1 + value / s["c"])
        return state(c, d, s["h"] * c * d)

    def both(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        half = F.transform(F.array(s), lambda one: term(one, even))[0]  # bound once, as the next term reads it several times
        return F.transform(F.array(half), lambda one: term(one, odd))[0]

    terms = F.ceil(60 + 6 * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), terms), state(F.lit(1.0), d0, d0), lambda s, m: both(s, m.cast("double")), lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a, b of a half and more and x from 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = x < (a + 1) / (a + b + 2)
    inside = F.when(low, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def t_p_value(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t; null without a degree of freedom."""
    v = freedom.cast("double")
    return F.when(v >= 1, incomplete_beta(v / 2, F.lit(0.5), v / (v + t * t)))
