"""Tail probabilities for the one result row of a comparison; Spark has no error function.

These run on a handful of rows after all aggregation, never on instances.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _t_two_sided(t: float, df: float) -> float:
    """By substitution t = sqrt(df) tan(a) the tail is an integral of cos(a) ** (df - 1)."""
    edge = math.atan2(abs(t), math.sqrt(df))
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    a = np.linspace(edge, math.pi / 2, 20001)
    y = np.exp(log_c + (df - 1) * np.log(np.maximum(np.cos(a), 1e-300)))
    weights = np.ones_like(a)
    weights[1:-1:2], weights[2:-1:2] = 4.0, 2.0
    return float(min(1.0, 2.0 * np.dot(weights, y) * (a[1] - a[0]) / 3.0))


def _binomial_two_sided(k: int, n: int, p: float) -> float:
    i = np.arange(n + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    mass = np.exp(logs + i * math.log(p) + (n - i) * math.log(1 - p))
    return float(min(1.0, mass[mass <= mass[k] * (1 + 1e-7)].sum()))


def _signed_rank_exact(w: float, n: int) -> float:
    """Two-sided exact probability of the signed-rank sum for untied differences."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for r in range(1, n + 1):
        shifted = np.zeros_like(counts)
        shifted[r:] = counts[:-r]
        counts = counts + shifted
    low = min(w, n * (n + 1) / 2 - w)
    return float(min(1.0, 2.0 * counts[: int(math.floor(low)) + 1].sum() / counts.sum()))


def _series(fn, *cols):
    def one(*values):
        if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in values):
            return None
        return fn(*values)
    return pd.Series([one(*row) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _series(_normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(lambda a, b: _t_two_sided(a, b) if b > 0 else None, t, df)


@F.pandas_udf(T.DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _series(lambda a, b, c: _binomial_two_sided(int(a), int(b), float(c)), k, n, p)


@F.pandas_udf(T.DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
    """Exact up to 50 untied pairs, normal beyond."""
    def one(a, b, c, d):
        return _signed_rank_exact(a, int(b)) if b <= 50 and d == 0 else _normal_two_sided(c)
    return _series(one, w, n, z, ties)
