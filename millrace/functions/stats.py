"""Exact and closed-form statistics as Column expressions; unmeasured is null, never 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact binomials switch to log space above this many trials, where the first term underflows.
LOG_SPACE_FROM = 1000


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]; null for n <= 0."""
    size = F.when(n > 0, n.cast("double"))
    p = successes / size
    denominator = 1 + z * z / size
    centre = (p + z * z / (2 * size)) / denominator
    margin = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / denominator
    return F.greatest(centre - margin, F.lit(0.0) + centre * 0), F.least(centre + margin, F.lit(1.0) + centre * 0)


def log_factorial(n: Column) -> Column:
    """ln n!: the Stirling series above 16 (error below 1e-14), a table of exact values up to there."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(17)])
    return F.when(n > 16, series).otherwise(F.get(small, F.greatest(n, F.lit(0)).cast("int")))


def binomial_tail(hits: Column, n: Column, p: float = 0.5) -> Column:
    """P(X >= hits) of a binomial variable, summed from log terms."""
    total = log_factorial(n)

    def term(k: Column) -> Column:
        return F.exp(total - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))

    tail = F.aggregate(F.sequence(F.greatest(hits, F.lit(0)).cast("int"), n.cast("int")), F.lit(0.0), lambda acc, k: acc + term(k))
    return F.when(n.isNull() | hits.isNull(), None).when(hits <= 0, 1.0).when(hits > n, 0.0).otherwise(F.least(tail, F.lit(1.0)))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p-value of two discordant counts; no discordance gives 1."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = F.when(i == 0, acc["term"]).otherwise(acc["term"] * (n - i + 1) / i)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    direct = F.aggregate(F.sequence(F.lit(0), k), start, step, lambda acc: acc["sum"])
    logs = binomial_tail(F.greatest(b, c), n)
    return F.when(n.isNull(), None).when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(n > LOG_SPACE_FROM, logs).otherwise(direct)))


#: The exact two-sided sign test is the same kernel.
sign_test = mcnemar


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher exact p-value: tables no likelier than the observed one; an empty margin gives 1."""
    row, col, n = a + b, a + c, a + b + c + d
    fixed = log_factorial(row) + log_factorial(n - row) + log_factorial(col) + log_factorial(n - col) - log_factorial(n)

    def prob(x: Column) -> Column:
        return F.exp(fixed - log_factorial(x) - log_factorial(row - x) - log_factorial(col - x) - log_factorial(n - row - col + x))

    lo, hi = F.greatest(F.lit(0), row + col - n).cast("int"), F.least(row, col).cast("int")
    seen = prob(a)
    total = F.aggregate(F.sequence(lo, hi), F.lit(0.0), lambda acc, x: acc + F.when(prob(x) <= seen + 1e-12, prob(x)).otherwise(0.0))
    return F.when((row == 0) | (row == n) | (col == 0) | (col == n), 1.0).otherwise(F.least(total, F.lit(1.0)))


# The coefficients of a published rational approximation of the inverse normal distribution.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution; null outside (0, 1)."""
    edge = 0.02425
    q = p - 0.5
    middle = _poly(_A, q * q) * q / _poly(_B, q * q)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when((p <= 0) | (p >= 1), None).when(p < edge, _poly(_C, low) / _poly(_D, low)).when(p > 1 - edge, -_poly(_C, high) / _poly(_D, high)).otherwise(middle)


def mcnemar_sample_size(delta: Column, discordance: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Pairs needed to see a rate difference ``delta`` at a discordance; null outside 0 < delta < 1, delta < discordance <= 1."""
    za, zb = normal_quantile(F.lit(1 - alpha / 2)), normal_quantile(F.lit(power))
    n = F.ceil(F.pow(za * F.sqrt(discordance) + zb * F.sqrt(discordance - delta * delta), 2) / (delta * delta))
    return F.when((delta > 0) & (delta < 1) & (discordance > delta) & (discordance <= 1), n)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation from sums; null for fewer than two pairs or no variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(x)
    vx, vy = n * F.sum(x * x) - F.sum(x) * F.sum(x), n * F.sum(y * y) - F.sum(y) * F.sum(y)
    ok = (n >= 2) & (vx > 1e-9) & (vy > 1e-9)
    return F.when(ok, (n * F.sum(x * y) - F.sum(x) * F.sum(y)) / F.sqrt(F.when(ok, vx * vy)))
