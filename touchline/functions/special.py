"""Special functions as column expressions: log gamma, regularised incomplete gamma and beta, and the p-values made of them.

Continued fractions and series run inside one row by ``aggregate`` (Lentz's method), so a p-value is an expression like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 400
TINY = 1e-300
#: Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0; below 1 by gamma(x) = gamma(x + 1) / x."""
    y = F.when(x < 1, x).otherwise(x - 1)  # gamma(y + 1)
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + i)
    t = y + 7.5
    out = F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(total)
    return F.when(x < 1, out - F.log(x)).otherwise(out)


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _terms(start: Column, step, out, terms: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, out)


def gamma_q(a: Column, x: Column, terms: int = TERMS) -> Column:
    """Regularised upper incomplete gamma Q(a, x): a series for 1 - Q below a + 1, a continued fraction above."""
    a, x = a.cast("double"), x.cast("double")
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    pair = F.struct((1.0 / a).alias("term"), (1.0 / a).alias("sum"))

    def more(s, i):
        term = s["term"] * x / (a + i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    low = 1.0 - scale * _terms(pair, more, lambda s: s["sum"], terms)
    b0 = x + 1.0 - a
    first = F.struct(b0.alias("b"), F.lit(1.0 / TINY).alias("c"), (1.0 / _safe(b0)).alias("d"), (1.0 / _safe(b0)).alias("h"))

    def lentz(s, i):
        an = -1.0 * i * (i.cast("double") - a)
        b = s["b"] + 2.0
        d = 1.0 / _safe(an * s["d"] + b)
        c = _safe(b + an / s["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    high = scale * _terms(first, lentz, lambda s: s["h"], terms)
    return F.when(x <= 0, 1.0).when(x < a + 1.0, F.greatest(low, F.lit(0.0))).otherwise(high)


def beta_i(a: Column, b: Column, x: Column, terms: int = TERMS) -> Column:
    """Regularised incomplete beta I_x(a, b) by its continued fraction, on the side where it converges fast."""
    a, b, x = (c.cast("double") for c in (a, b, x))

    def fraction(p: Column, q: Column, at: Column) -> Column:
        d0 = 1.0 / _safe(1.0 - (p + q) * at / (p + 1.0))
        first = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def lentz(s, i):
            m = i.cast("double")
            even = m * (q - m) * at / ((p + 2.0 * m - 1.0) * (p + 2.0 * m))
            odd = -(p + m) * (p + q + m) * at / ((p + 2.0 * m) * (p + 2.0 * m + 1.0))
            d1 = 1.0 / _safe(1.0 + even * s["d"])
            c1 = _safe(1.0 + even / s["c"])
            d2 = 1.0 / _safe(1.0 + odd * d1)
            c2 = _safe(1.0 + odd / c1)
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

        return _terms(first, lentz, lambda s: s["h"], terms) / p

    scale = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    near = x < (a + 1.0) / (a + b + 2.0)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, scale * fraction(a, b, x)).otherwise(1.0 - scale * fraction(b, a, 1.0 - x))


def chi2_p(x: Column, df: Column) -> Column:
    """Chance of a chi-square value of ``x`` or more."""
    return gamma_q(df / 2.0, x / 2.0)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided chance of a t value as far from 0."""
    return beta_i(df / 2.0, F.lit(0.5), df / (df + t * t))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of ``n`` pairs; 0 for a perfect one, null for fewer than three pairs."""
    df = n.cast("double") - 2.0
    return F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(t_p(r * F.sqrt(df / ((1.0 - r) * (1.0 + r))), df))
