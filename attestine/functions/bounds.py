"""Exact binomial bounds."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _upper_tail(x: int, n: int, p: float) -> float:
    """P(X >= x) for a binomial with chance p, from whichever tail has fewer terms."""
    if p <= 0:
        return 1.0 if x <= 0 else 0.0
    if p >= 1:
        return 1.0
    terms = lambda ks: math.fsum(math.exp(_log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in ks)
    return terms(range(x, n + 1)) if n - x < x else 1 - terms(range(x))


def _solve(reaches) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if reaches(mid) else (mid, high)
    return (low + high) / 2


def check(x: int, n: int, alpha: float) -> None:
    if n <= 0 or not 0 <= x <= n or not 0 < alpha < 1:
        raise ValueError("needs 0 <= x <= n, n > 0 and 0 < alpha < 1")


def clopper_pearson_lower(x: int, n: int, alpha: float) -> float:
    """The chance at which x or more of n have probability alpha; 0 for x = 0."""
    check(x, n, alpha)
    return 0.0 if x == 0 else _solve(lambda p: _upper_tail(x, n, p) >= alpha)


def clopper_pearson_upper(x: int, n: int, alpha: float) -> float:
    """The chance at which x or fewer of n have probability alpha; 1 for x = n."""
    check(x, n, alpha)
    return 1.0 if x == n else _solve(lambda p: 1 - _upper_tail(x + 1, n, p) <= alpha)


def bound(x: Column, n: Column, alpha: float, upper: bool = False) -> Column:
    """One-sided bound for aggregate rows; 0 for n = 0."""
    solve = clopper_pearson_upper if upper else clopper_pearson_lower

    @F.pandas_udf(T.DoubleType())
    def solved(xs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([solve(int(a), int(b), alpha) if b else 0.0 for a, b in zip(xs, ns, strict=True)], dtype=float)

    return solved(x, n)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
