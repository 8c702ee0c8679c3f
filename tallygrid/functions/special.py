"""Tail probabilities of the test distributions, applied to small result frames."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_reg(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_reg(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_reg(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_upper(x: float) -> float:
    if x <= 0:
        return 1.0
    if x < 0.3:  # the alternating series converges slowly here and the value is 1 to 5 digits
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi ** 2 / (8 * x * x)) for k in range(1, 50))
        return 1.0 - math.sqrt(2 * math.pi) / x * s
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _lift(fn, *cols: Column) -> Column:
    """Evaluate a probability on the few rows of a test result."""
    def run(*series: pd.Series) -> pd.Series:
        rows = zip(*series)
        return pd.Series([None if any(v is None or v != v for v in r) else fn(*map(float, r)) for r in rows],
                         dtype="float64")
    n = len(cols)
    if n == 1:
        def call(a: pd.Series) -> pd.Series:
            return run(a)
    elif n == 2:
        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)
    else:
        def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run(a, b, c)
    return F.pandas_udf(call, "double")(*[c.cast("double") for c in cols])


def p_t(t, df): return _lift(t_two_sided, t, df)
def p_f(f, d1, d2): return _lift(f_upper, f, d1, d2)
def p_chi2(x, df): return _lift(chi2_upper, x, df)
def p_normal(z): return _lift(normal_two_sided, z)
def p_kolmogorov(x): return _lift(kolmogorov_upper, x)
