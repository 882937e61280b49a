"""Arithmetic that follows IEEE rules and R's conventions where Spark's ANSI mode differs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b for doubles; a zero divisor gives an infinity of a's sign, or NaN for 0/0, instead of an error."""
    at_zero = F.when(a > 0, F.when(F.isnan(a), NAN).otherwise(INF)).when(a < 0, -INF).when(a.isNotNull(), NAN)
    return F.when(b == 0, at_zero).otherwise(a / F.when(b != 0, b))


def ieee_ln(x: Column) -> Column:
    """Natural logarithm: -Infinity at 0 and NaN below, where Spark gives null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, -INF).when(x.isNotNull(), NAN)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def average_rank(value: Column, *by: str) -> Column:
    """Rank within groups, ties sharing the mean of their ranks; nulls have none."""
    ranked = F.rank().over(Window.partitionBy(*by, value.isNull()).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), ranked + (ties - 1) / 2.0)


def qchisq(p: float, df: int) -> float:
    """Quantile of the chi-square distribution, by bisection on the regularised lower incomplete gamma function."""

    def lower(a: float, x: float) -> float:
        if x <= 0:
            return 0.0
        if x < a + 1:  # power series
            term = total = 1 / a
            n = a
            while abs(term) > 1e-16 * abs(total):
                n += 1
                term *= x / n
                total += term
            return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
        b, c = x + 1 - a, 1e300  # continued fraction for the upper part
        d = h = 1 / b
        for k in range(1, 500):
            an = -k * (k - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))

    if not 0 <= p < 1:
        raise ValueError("p must be in [0, 1)")
    lo, hi = 0.0, max(1.0, float(df))
    while lower(df / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if lower(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def half_even(x: np.ndarray) -> np.ndarray:
    return np.rint(x)
