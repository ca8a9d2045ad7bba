"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln n!: exact up to 20, then Stirling's series, whose error is below 1e-12 there. No table that grows."""
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def fisher_greater(a: Column, b: Column, pos: Column, neg: Column) -> Column:
    """One-sided Fisher's exact test of [[a, pos - a], [b, neg - b]] for more in the first row. What is the same in all
    of a test's terms is taken once."""
    k = a + b
    same = F.struct(log_factorial(pos).alias("pos"), log_factorial(neg).alias("neg"), (log_factorial(pos + neg) - log_factorial(k) - log_factorial(pos + neg - k)).alias("all"))

    def term(x: Column, c: Column) -> Column:
        inside = c["pos"] - log_factorial(x) - log_factorial(pos - x) + c["neg"] - log_factorial(k - x) - log_factorial(neg - k + x)
        return F.when((k - x >= 0) & (k - x <= neg), F.exp(inside - c["all"])).otherwise(0.0)

    return F.get(F.transform(F.array(same), lambda c: F.aggregate(F.sequence(a, F.least(pos, k)), F.lit(0.0), lambda s, x: s + term(x, c))), F.lit(0))


def fold_change(a: Column, b: Column, pos: Column, neg: Column) -> Column:
    """Share in positives over share in negatives, with one added to the negatives."""
    return (a / pos) / ((b + 1) / (neg + 1))


def fold_change_raw(a: Column, b: Column, pos: Column, neg: Column) -> Column:
    """The same without smoothing, infinite without negatives."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise((a / pos) / F.nullif(b / neg, F.lit(0.0)))


def chi2_presence(a: Column, b: Column, pos: Column, neg: Column) -> Column:
    """Chi-squared of presence counts per class against class shares (presence cells only)."""
    t = a + b
    ea, eb = t * pos / (pos + neg), t * neg / (pos + neg)
    return (a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb


def witness(pos: Column, neg: Column, method: str = "log2_fold_change") -> Column:
    """A sequence's witness score."""
    if method == "log2_fold_change":
        return F.log2((pos + 1) / (neg + 1))
    if method == "fold_change":
        return (pos + 1) / (neg + 1)
    if method == "ratio":
        return pos / F.greatest(pos + neg, F.lit(1))
    raise ValueError(f"unknown witness method: {method}")


def corrected_skew(x: Column) -> Column:
    """Bias-corrected skewness, null below three values."""
    n = F.count(x)
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def corrected_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis, null below four values."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
