"""Student-t critical values for small tables of contrasts."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_coverage(value: float, df: int) -> float:
    """P(|T| <= value) for integer degrees of freedom, as a finite trigonometric sum."""
    theta = math.atan(value / math.sqrt(df))
    sine, square = math.sin(theta), math.cos(theta) ** 2
    if df % 2:
        term, total = math.cos(theta), 0.0
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= square * (2 * k) / (2 * k + 1)
        return 2.0 / math.pi * (theta + sine * total)
    term, total = 1.0, 0.0
    for k in range(1, df // 2 + 1):
        total += term
        term *= square * (2 * k - 1) / (2 * k)
    return sine * total


def t_critical(df: int, coverage: float = 0.95) -> float:
    low, high = 0.0, 1.0
    while t_coverage(high, df) < coverage:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_coverage(middle, df) < coverage:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def t_critical_95(df: Column) -> Column:
    """Two-sided 95 % critical value as a column: exact to 100, then an expansion in 1/df."""
    exact = F.array(*[F.lit(t_critical(n)) for n in range(1, 101)])
    z = NormalDist().inv_cdf(0.975)
    terms = (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    tail = sum((F.lit(term) / F.pow(df.cast("double"), F.lit(k)) for k, term in enumerate(terms)), F.lit(0.0))
    return F.when(df < 1, F.lit(None)).when(df <= 100, F.get(exact, (df - 1).cast("int"))).otherwise(tail)
