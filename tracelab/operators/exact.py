"""Exact tests on counts: binomial tails, equivalence, bounds, agreement beyond chance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the product of the eight steps; x > 0."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    down = x
    for i in range(1, 8):
        down = down * (x + i)
    return series - F.ln(down)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def at_least(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X binomial (n, p), 0 < p < 1: terms from logarithms, summed where they aren't nothing in a double.
    Terms further than 40 deviations (and 800) from the mean are less than the smallest double."""
    n, k, p = n.cast("double"), k.cast("double"), p.cast("double")
    reach = 40 * F.sqrt(n * p * (1 - p)) + 800
    low = F.greatest(k, F.floor(n * p - reach).cast("double"), F.lit(0.0))
    high = F.least(n, F.ceil(F.greatest(k, n * p) + reach).cast("double"))
    term = lambda i: F.exp(log_choose(n, i.cast("double")) + i * F.ln(p) + (n - i) * F.ln(1 - p))
    total = F.aggregate(F.sequence(low.cast("long"), high.cast("long")), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(n.isNull() | k.isNull() | p.isNull(), F.lit(None).cast("double")).when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.least(total, F.lit(1.0)))


def at_most(k: Column, n: Column, p: Column) -> Column:
    return at_least(n - k, n, 1 - p)


def two_sided(k: Column, n: Column, p: Column) -> Column:
    """Twice the smaller tail."""
    return F.least(F.lit(1.0), 2 * F.least(at_least(k, n, p), at_most(k, n, p)))


def equivalence(k: Column, n: Column, p: float, margin: float) -> Column:
    """Two one-sided tests: the larger of the tails at either end of p +- margin."""
    return F.greatest(at_least(k, n, F.lit(p - margin)), at_most(k, n, F.lit(p + margin)))


def upper_bound(k: Column, n: Column, alpha: float = 0.05, steps: int = 50) -> Column:
    """The largest rate that k or fewer of n wouldn't reject: by halving, to 2 ** -steps."""
    half = lambda s: (s["lo"] + s["hi"]) / 2
    step = lambda s, _: F.when(at_most(k, n, half(s)) > alpha, F.struct(half(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step, half)
    return F.when(n <= 0, F.lit(None).cast("double")).when(k >= n, F.lit(1.0)).otherwise(found)


def kappa(yes_yes: Column, yes_no: Column, no_yes: Column, no_no: Column) -> Column:
    """Cohen's kappa of two raters; null if chance alone agrees always."""
    n = yes_yes + yes_no + no_yes + no_no
    agree = (yes_yes + no_no) / n
    chance = ((yes_yes + yes_no) * (yes_yes + no_yes) + (no_no + yes_no) * (no_no + no_yes)) / (n * n)
    return F.when((n > 0) & (chance < 1), (agree - chance) / (1 - chance))


def pabak(agree: Column, n: Column) -> Column:
    """Kappa with prevalence and bias set even."""
    return F.when(n > 0, 2 * agree / n - 1)
