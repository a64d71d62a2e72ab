"""Quantiles of Student's t distribution."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE = 200
_NORMAL = 1.959963984540054  # the normal 97.5 % quantile


@lru_cache(maxsize=1)
def _nodes() -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(64)


def _upper(t: float, dof: int) -> float:
    """P(T <= t) - 0.5 by Gauss-Legendre integration of the density."""
    x, w = _nodes()
    x = (x + 1) * t / 2
    log_c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
    return float((w * np.exp(log_c - (dof + 1) / 2 * np.log1p(x * x / dof))).sum() * t / 2)


@lru_cache(maxsize=1)
def t_table() -> list[float]:
    """The 97.5 % quantiles for 1 to ``TABLE`` degrees of freedom, by bisection."""
    found = []
    for dof in range(1, TABLE + 1):
        low, high = 0.0, 13.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if _upper(mid, dof) < 0.475 else (low, mid)
        found.append((low + high) / 2)
    return found


def t_quantile(dof: Column) -> Column:
    """The 97.5 % quantile: from the table, beyond it by the Cornish-Fisher expansion."""
    z, n = _NORMAL, dof.cast("double")
    beyond = z + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n * n)
    return F.when(dof < 1, None).when(dof <= TABLE, F.get(F.array(*map(F.lit, t_table())), (dof - 1).cast("int"))).otherwise(beyond)
