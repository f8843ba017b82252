"""Column functions for distributions and scores; all stay within generated code or higher-order functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def log_factorial_terms(k: Column) -> Column:
    """ln k!: from a table up to 32, beyond by Stirling's series, whose error is below 1e-14 there."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(33)])
    x = F.greatest(k, F.lit(32)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k > 32, series).otherwise(F.element_at(table, (F.greatest(F.least(k, F.lit(32)), F.lit(0)) + 1).cast("int")))


def poisson_pmf(k: Column, rate: Column) -> Column:
    """exp(k ln(rate) - rate - ln k!); a rate of 0 puts all mass on 0."""
    return F.when(rate > 0, F.exp(k * F.log(rate) - rate - log_factorial_terms(k))).otherwise(F.when(k == 0, 1.0).otherwise(0.0))


def poisson_cdf(k: Column, rate: Column) -> Column:
    """Sum of the masses 0..k: upwards from the mass at 0, or, where that is too small for a double, downwards from the mass at k.

    Beyond 40 deviations above the rate it is 1, and masses of more than 40 deviations below k are left out: there are some
    hundreds of steps for small rates and the square root's order for large ones.
    """
    reach = 40 * F.sqrt(rate) + 40
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"))
    none = F.array().cast("array<int>")
    upwards = F.when((k >= 1) & (rate < 600), F.sequence(F.lit(1), F.greatest(F.least(k, rate + reach), F.lit(1)).cast("int"))).otherwise(none)
    up = F.aggregate(upwards, start, lambda s, i: F.struct((s["term"] * rate / i).alias("term"), (s["total"] + s["term"] * rate / i).alias("total")), lambda s: s["total"])
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    near = (k >= 1) & (rate >= 600) & (k <= rate + reach)
    downwards = F.when(near, F.sequence(k.cast("int"), F.greatest(k - 2 * reach, F.lit(1)).cast("int"), F.lit(-1))).otherwise(none)
    down = F.aggregate(downwards, one, lambda s, i: F.struct((s["term"] * i / rate).alias("term"), (s["total"] + s["term"] * i / rate).alias("total")), lambda s: s["total"])
    total = F.when(k > rate + reach, 1.0).when(rate < 600, up).otherwise(poisson_pmf(k, rate) * down)
    return F.when(k >= 0, total).otherwise(0.0)


def scan_pvalue(k: Column, rate: Column, window: Column, total: Column) -> Column:
    """P-value of the scan statistic for k counts in a window of ``window`` positions out of ``total``, at ``rate`` per position; 1 for k <= 2."""
    mean = rate * window
    a = ((k - mean) / k) * (rate * (total - window) * poisson_pmf(k - 1, mean))
    p = F.least(F.lit(1.0), F.abs(1 - poisson_cdf(k - 1, mean) * F.exp(-a)))
    return F.when(k <= 2, F.lit(1.0)).otherwise(p)


def approximate_scan_pvalue(k: Column, rate: Column, window: Column, total: Column, alpha: float) -> Column:
    """As ``scan_pvalue``, but the first partial sum's p-value that falls below ``alpha`` is the result."""
    mean = rate * window
    a = ((k - mean) / k) * (rate * (total - window) * poisson_pmf(k - 1, mean))
    p_of = lambda total_: F.least(F.lit(1.0), F.abs(1 - total_ * F.exp(-a)))
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("p"))

    def step(s: Column, i: Column) -> Column:
        term = F.when(i == 0, F.exp(-mean)).otherwise(s["term"] * mean / F.greatest(i, F.lit(1)))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"), F.coalesce(s["p"], F.when(p_of(s["total"] + term) < alpha, p_of(s["total"] + term))).alias("p"))

    found = F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)).cast("int")), start, step, lambda s: F.coalesce(s["p"], p_of(s["total"])))
    return F.when(k <= 2, F.lit(1.0)).otherwise(found)


def _sum_of_terms(first: Column, low: Column, high: Column, ratio) -> Column:
    """first + the terms after it up to ``high``, each ``ratio(i)`` times the one at i - 1."""
    steps = F.when(high > low, F.sequence((low + 1).cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(first.alias("term"), first.alias("total"))
    return F.aggregate(steps, start, lambda s, i: F.struct((s["term"] * ratio(i)).alias("term"), (s["total"] + s["term"] * ratio(i)).alias("total")), lambda s: s["total"])


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k, from min(k, n - k) quotients."""
    few = F.least(k, n - k)
    return F.aggregate(F.when(few >= 1, F.sequence(F.lit(1), few.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.log((n - few + i) / i))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for a binomial: the mass at k, and each further one from the one before."""
    first = F.exp(log_choose(n, k) + k * F.log(p) + (n - k) * F.log1p(-p))
    total = _sum_of_terms(first, k, n, lambda i: (n - i + 1) / i * p / (1 - p))
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def hypergeometric_tail(k: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """P(X >= k) marked ones among ``drawn`` out of ``total`` with ``marked``: the mass at k, and each further one from the one before."""
    low, high = F.greatest(k, drawn + marked - total, F.lit(0)), F.least(drawn, marked)
    first = F.exp(log_choose(marked, low) + log_choose(total - marked, drawn - low) - log_choose(total, drawn))
    tail = _sum_of_terms(first, low, high, lambda i: (marked - i + 1) / i * (drawn - i + 1) / (total - marked - drawn + i))
    return F.when(low > high, F.lit(0.0)).otherwise(F.least(F.lit(1.0), tail))


def chi2_even_tail(x: Column, n: Column) -> Column:
    """P(X > x) of chi-square with 2n degrees of freedom: exp(-x/2) * sum of (x/2)^i / i! for i < n."""
    return poisson_cdf(n - 1, x / 2)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function: a series within 6 deviations, 0 or 1 beyond."""
    start = F.struct(z.alias("term"), z.alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, lambda s, i: F.struct((s["term"] * z * z / (2 * i + 1)).alias("term"), (s["total"] + s["term"] * z * z / (2 * i + 1)).alias("total")), lambda s: s["total"])
    return F.when(z < -6, 0.0).when(z > 6, 1.0).otherwise(0.5 + series * F.exp(-z * z / 2) / float(np.sqrt(2 * np.pi)))


def close_to_1(x: Column) -> Column:
    return F.abs(x - 1) < 1e-8


def binomial_coefficient(n: Column, k: Column) -> Column:
    """n over k for n up to 20, as factorials hold no more; null beyond."""
    return F.when((k >= 0) & (k <= n), F.call_function("div", F.factorial(n), F.factorial(k) * F.factorial(n - k)))


def fold(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def abs_fold(a: Column, b: Column) -> Column:
    return F.greatest(F.try_divide(a, b), F.try_divide(b, a))


def unfair_die(u: Column, probabilities: list[float]) -> Column:
    """Face (from 0) that a uniform number ``u`` of [0, 1) rolls; the probabilities must add up to 1."""
    if abs(sum(probabilities) - 1) > 1e-8:
        raise ValueError("probabilities must add up to 1")
    out, bound = F.lit(len(probabilities) - 1), 1.0
    for i in range(len(probabilities) - 2, -1, -1):
        bound = sum(probabilities[: i + 1])
        out = F.when(u < bound, F.lit(i)).otherwise(out)
    return out


# vectors: array<double> columns


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of equal length; null if one is constant."""
    ca = F.transform(a, lambda x: x.cast("double") - mean_of(a))
    cb = F.transform(b, lambda x: x.cast("double") - mean_of(b))
    return F.try_divide(dot(ca, cb), F.sqrt(dot(ca, ca) * dot(cb, cb)))


def pearson_distance(a: Column, b: Column) -> Column:
    return 1 - pearson(a, b)


def absolute_pearson_distance(a: Column, b: Column) -> Column:
    return 1 - F.abs(pearson(a, b))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two distributions."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) / 2 + part(y, (x + y) / 2) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x)))


# what has no closed form: Arrow batches


@F.pandas_udf(DoubleType())
def noncentral_chi2_cdf(x: pd.Series, df: pd.Series, noncentrality: pd.Series) -> pd.Series:
    """Distribution function of the noncentral chi-square by its Poisson mixture."""
    return pd.Series([_ncx2(float(a), float(b), float(c)) for a, b, c in zip(x, df, noncentrality, strict=True)])


def _gamma_p(a: float, x: float) -> float:
    """Lower regularized incomplete gamma function."""
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * exp(-x + a * log(x) - lgamma(a))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h, i = d, 1
    while True:
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15 or i > 10_000:
            return 1 - exp(-x + a * log(x) - lgamma(a)) * h
        i += 1


def _ncx2(x: float, df: float, noncentrality: float) -> float:
    from math import exp, lgamma, log

    if df <= 0 or noncentrality <= 0:
        raise ValueError("degrees of freedom and noncentrality must be above 0")
    half, total, i, left = noncentrality / 2, 0.0, 0, 1.0
    while left > 1e-15 and i < 10_000:
        weight = exp(-half + i * log(half) - lgamma(i + 1))
        total += weight * _gamma_p(df / 2 + i, x / 2)
        left -= weight
        i += 1
        if i > half and weight < 1e-18:
            break
    return total


def skellam_cdf(k: int, rate1: float, rate2: float) -> float:
    """P(X1 - X2 <= k) of two Poisson variables."""
    if rate1 <= 0 or rate2 <= 0:
        raise ValueError("both rates must be above 0")
    return 1 - _ncx2(2 * rate1, 2 * (k + 1), 2 * rate2) if k >= 0 else _ncx2(2 * rate2, -2 * k, 2 * rate1)


@F.pandas_udf(DoubleType())
def skellam_pvalue(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The smaller tail of the difference of two Poisson variables at k."""
    for k, a, b in batches:
        yield pd.Series([min(skellam_cdf(int(x), y, z), 1 - skellam_cdf(int(x) - 1, y, z)) for x, y, z in zip(k, a, b, strict=True)], dtype=float)


@F.pandas_udf(ArrayType(DoubleType()))
def polynomial_roots(coefficients: pd.Series) -> pd.Series:
    """Real and imaginary parts, in turn, of a polynomial's roots (highest power first), sorted."""
    return pd.Series([[v for r in sorted(np.roots(c), key=lambda r: (round(r.real, 9), round(r.imag, 9))) for v in (float(r.real), float(r.imag))] for c in coefficients])


@F.pandas_udf(DoubleType())
def noncentral_chi2_density(x: pd.Series, df: pd.Series, noncentrality: pd.Series) -> pd.Series:
    """Density of the noncentral chi-square by its Poisson mixture of central ones; 0 below 0."""
    return pd.Series([_ncx2_density(float(a), float(b), float(c)) for a, b, c in zip(x, df, noncentrality, strict=True)])


def _ncx2_density(x: float, df: float, noncentrality: float) -> float:
    from math import exp, lgamma, log

    if df <= 0 or noncentrality <= 0:
        raise ValueError("degrees of freedom and noncentrality must be above 0")
    if x <= 0:
        return 0.0
    half, total, i, left = noncentrality / 2, 0.0, 0, 1.0
    while left > 1e-16 and i < 10_000:
        weight = exp(-half + i * log(half) - lgamma(i + 1))
        k = df / 2 + i
        total += weight * exp((k - 1) * log(x) - x / 2 - k * log(2) - lgamma(k))
        left -= weight
        i += 1
        if i > half and weight < 1e-18:
            break
    return total


@F.pandas_udf(DoubleType())
def skellam_left(k: pd.Series, rate1: pd.Series, rate2: pd.Series) -> pd.Series:
    """P(X1 - X2 <= k) of two Poisson variables."""
    return pd.Series([skellam_cdf(int(x), float(a), float(b)) for x, a, b in zip(k, rate1, rate2, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def skellam_right(k: pd.Series, rate1: pd.Series, rate2: pd.Series) -> pd.Series:
    """P(X1 - X2 >= k) of two Poisson variables."""
    return pd.Series([1 - skellam_cdf(int(x) - 1, float(a), float(b)) for x, a, b in zip(k, rate1, rate2, strict=True)], dtype=float)


def z_score_of_all(x: Column, mean: Column, deviation: Column, n: Column) -> Column:
    """Deviation from the mean in population standard deviations, from the sample's."""
    return F.try_divide(x - mean, deviation * F.sqrt((n - 1) / n))


def relative_abundance(x: Column, total: Column) -> Column:
    return F.try_divide(x.cast("double"), total.cast("double"))
