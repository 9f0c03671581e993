"""Tail probabilities and critical values as Columns.

Spark ships commons-math3; its special functions are static methods, so p-values are
ordinary lazy expressions on aggregated rows and work for one test or a million groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = "org.apache.commons.math3.special."


def _special(cls: str, method: str, *args: Column) -> Column:
    ok = F.lit(True)
    for a in args:
        ok = ok & a.isNotNull() & ~F.isnan(a)
    safe = [F.coalesce(a.cast("double"), F.lit(float("nan"))) for a in args]
    value = F.java_method(F.lit(_SPECIAL + cls), F.lit(method), *safe).cast("double")
    return F.when(ok, value)


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def log_gamma(x) -> Column:
    return _special("Gamma", "logGamma", _d(x))


def erfc(x) -> Column:
    return _special("Erf", "erfc", _d(x))


def normal_cdf(z) -> Column:
    return erfc(-_d(z) / math.sqrt(2)) / 2


def normal_sf(z) -> Column:
    return erfc(_d(z) / math.sqrt(2)) / 2


def incomplete_beta(x, a, b) -> Column:
    """Infinite degrees of freedom or a statistic at the edge would not converge: guard both."""
    x = _d(x)
    inner = _special("Beta", "regularizedBeta", F.when((x > 0) & (x < 1), x), _d(a), _d(b))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def t_two_sided(t, df) -> Column:
    t, df = _d(t), _d(df)
    return incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))


def t_p(t, df, alternative: str = "two-sided") -> Column:
    t = _d(t)
    both = t_two_sided(t, df)
    if alternative == "two-sided":
        return both
    upper = F.when(t >= 0, both / 2).otherwise(1 - both / 2)
    return upper if alternative == "greater" else 1 - upper


def z_p(z, alternative: str = "two-sided") -> Column:
    z = _d(z)
    if alternative == "two-sided":
        return F.least(F.lit(1.0), 2 * normal_sf(F.abs(z)))
    return normal_sf(z) if alternative == "greater" else normal_cdf(z)


def f_sf(f, d1, d2) -> Column:
    f, d1, d2 = _d(f), _d(d1), _d(d2)
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_sf(x, df) -> Column:
    x, df = _d(x), _d(df)
    return F.when(x <= 0, 1.0).otherwise(_special("Gamma", "regularizedGammaQ", df / 2, F.when(x > 0, x) / 2))


def binomial_half_p(k, n, alternative: str = "two-sided") -> Column:
    """Exact test of k successes in n fair trials, through the incomplete beta function."""
    k, n = _d(k), _d(n)

    def cdf(x):
        inner = _special("Beta", "regularizedBeta", F.lit(0.5), F.when(x < n, n - x), F.when(x < n, x + 1))
        return F.when(x >= n, 1.0).when(x < 0, 0.0).otherwise(inner)

    if alternative == "less":
        return cdf(k)
    if alternative == "greater":
        return 1 - cdf(k - 1)
    return F.least(F.lit(1.0), 2 * cdf(F.least(k, n - k)))


def normal_quantile(p) -> Column:
    return math.sqrt(2) * _special("Erf", "erfInv", 2 * _d(p) - 1)


def t_quantile(p, df) -> Column:
    """Newton steps from the normal quantile on the t distribution, folded per row."""
    p, df = _d(p), _d(df)
    scale = log_gamma((df + 1) / 2) - log_gamma(df / 2) - F.log(df * math.pi) / 2
    start = normal_quantile(p)
    # Cornish-Fisher start keeps Newton inside its basin for small df.
    start = start + (F.pow(start, 3) + start) / (4 * df)

    def step(x, _):
        tail = t_two_sided(x, df) / 2
        cdf = F.when(x >= 0, 1 - tail).otherwise(tail)
        density = F.exp(scale - (df + 1) / 2 * F.log(1 + x * x / df))
        return x - (cdf - p) / density

    rounds = F.sequence(F.lit(1), F.lit(40))
    return F.when(p.isNotNull() & df.isNotNull(), F.aggregate(rounds, start, step))


def magnitude(value: Column, low: float = 0.2, mid: float = 0.5, high: float = 0.8) -> Column:
    a = F.abs(value)
    return (
        F.when(value.isNull(), None).when(a < low, "negligible").when(a < mid, "small")
        .when(a < high, "medium").otherwise("large")
    )
