"""Closed forms of evaluation statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k in n; (0, 0) without any."""
    n, k = n.cast("double"), k.cast("double")
    p, zz = k / n, z * z
    centre, spread = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - spread)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + spread)).otherwise(0.0)


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 8, and the recurrence down from there."""
    x = z + 8.0
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    down = F.lit(0.0)
    for i in range(8):
        down = down + F.log(z + float(i))
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - down


def beta_share(x: Column, a: Column, b: Column, terms: int = 400) -> Column:
    """The regularised incomplete beta function for 0 <= x <= 1, a, b > 0, by its continued fraction (Lentz's way).

    The fraction converges fast below (a + 1) / (a + b + 2); beyond, the complement is taken.
    """
    tiny = 1e-300
    away = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def lower(x: Column, a: Column, b: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("f"), F.lit(1.0).alias("c"), F.lit(0.0).alias("d"))

        def step(s: Column, i: Column) -> Column:
            m = F.floor(i / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            n = F.when(i == 0, 1.0).when(i % 2 == 0, even).otherwise(odd)
            d = 1.0 / away(1.0 + n * s["d"])
            c = away(1.0 + n / s["c"])
            return F.struct((s["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

        fraction = F.aggregate(F.sequence(F.lit(0), F.lit(terms)), start, step, lambda s: s["f"] - 1.0)
        return F.exp(a * F.log(x) + b * F.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a * fraction

    direct = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(direct, lower(x, a, b)).otherwise(1.0 - lower(1 - x, b, a))


def correlation_p(rho: Column, n: Column) -> Column:
    """The two-sided probability of a correlation as far from 0, by Student's t with n - 2 degrees of freedom; null for n < 3."""
    p = beta_share(1.0 - rho * rho, (n.cast("double") - 2) / 2, F.lit(0.5))
    return F.when(n > 2, F.when(F.abs(rho) >= 1, 0.0).otherwise(p))
