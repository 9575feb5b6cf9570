"""Tail probabilities of Student's t and chi-square, for the few rows of a test result.

Standard series and continued fractions of the incomplete beta and gamma functions
(see any handbook of mathematical functions) while they converge fast, and the
integral of the density beyond: there the logarithms of large gamma functions are
taken apart by Stirling's series first, so nothing cancels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY, _EPS, _STEPS = 1e-300, 1e-15, 10_000
# Degrees of freedom beyond which densities are integrated; series need far fewer than _STEPS terms below.
_LARGE = 2_000
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def _fraction(terms, start: float) -> float:
    """Value of start + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method."""
    f = start or _TINY
    c, d = f, 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        f *= c * d
        if abs(c * d - 1.0) < _EPS:
            return f
    raise ArithmeticError("continued fraction has not converged")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)

    def terms():
        for m in range(_STEPS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    log_front = (
        a * math.log(x) + b * math.log1p(-x)
        + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )
    return math.exp(log_front) / (a * _fraction(terms(), 1.0))


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        for n in range(1, _STEPS):
            term *= x / (s + n)
            total += term
            if term < total * _EPS:
                return 1.0 - front * total
        raise ArithmeticError("series has not converged")
    terms = ((-n * (n - s), x + 2 * n + 1.0 - s) for n in range(1, _STEPS))
    return front / _fraction(terms, x + 1.0 - s)


def _stirling(x: float) -> float:
    """log gamma(x) less its leading part (x - 1/2) log x - x + log(2 pi) / 2, for large x."""
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _integral(f, low: float, high: float) -> float:
    """Integral of a smooth function."""
    half = (high - low) / 2
    return half * float(np.dot(_WEIGHTS, f(low + half * (_NODES + 1))))


def _log1p_rest(u: np.ndarray) -> np.ndarray:
    """u - log(1 + u), without cancellation near 0."""
    near = u * u * (1 / 2 - u * (1 / 3 - u * (1 / 4 - u * (1 / 5 - u * (1 / 6 - u * (1 / 7 - u / 8))))))
    return np.where(np.abs(u) < 0.01, near, u - np.log1p(u))


def gamma_upper_large(s: float, x: float) -> float:
    """gamma_upper for large s: the density of t = s (1 + u) over the tail that is away from the mode."""

    def density(u):
        return np.exp(-s * _log1p_rest(u) - np.log1p(u)) * math.sqrt(s / (2 * math.pi)) * math.exp(-_stirling(s))

    u = x / s - 1
    slope = s * abs(u / (1 + u))
    width = min(12 * (1 + max(u, 0.0)) / math.sqrt(s), 45 / slope if slope else math.inf)
    if u >= 0:
        return _integral(density, u, u + width)
    return 1.0 - _integral(density, max(u - width, -1 + 1e-12), u)


def student_two_sided_large(t: float, dof: float) -> float:
    """Probability of |T| >= t for many degrees of freedom."""
    half = dof / 2
    # log of gamma(half + 1/2) / gamma(half) / sqrt(half)
    ratio = half * math.log1p(1 / (2 * half)) - 0.5 + _stirling(half + 0.5) - _stirling(half)
    front = math.exp(ratio) / math.sqrt(2 * math.pi)

    def density(x):
        return np.exp(-(half + 0.5) * np.log1p(x * x / dof))

    slope = (dof + 1) * t / (dof + t * t)
    width = min(14 + t, 45 / slope if slope else math.inf)
    return min(1.0, 2 * front * _integral(density, t, t + width))


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p of a Pearson correlation over n pairs."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1.0:
        return 0.0
    dof = n - 2
    t2 = r * r * dof / (1.0 - r * r)
    if dof > _LARGE:
        return student_two_sided_large(math.sqrt(t2), dof)
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t2))


def chi_square_p(statistic: float, dof: int) -> float | None:
    if statistic is None or dof is None or math.isnan(statistic) or dof < 0:
        return None
    if dof == 0:
        return 1.0
    upper = gamma_upper_large if dof > 2 * _LARGE else gamma_upper
    return upper(dof / 2.0, statistic / 2.0)


def _optional(x):
    return None if pd.isna(x) else x


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(_optional(a), _optional(b)) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi_square_p_value(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [chi_square_p(_optional(a), _optional(b)) for a, b in zip(statistic, dof)], dtype="float64"
    )
