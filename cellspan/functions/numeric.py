"""Numeric column expressions with a defined result where the plain operator would raise or give inf or NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs_of(n: Column) -> Column:
    """n * (n - 1) / 2, as a double."""
    n = n.cast("double")
    return n * (n - 1) / 2


def plogp(p: Column) -> Column:
    """p * ln(p), and 0 where p is 0."""
    return F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))


def without_nan(value: Column) -> Column:
    """NaN as NULL, since NaN would rank above every number."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


#: Below this, ln(n!) comes from a table of exact values; from there on Stirling's series is exact to a double's precision.
_SMALL = 16
_LOG_FACTORIALS = [math.log(math.factorial(n)) for n in range(_SMALL)]


def log_factorial(n: Column) -> Column:
    """ln(n!) for integers n >= 0, without a table that grows with the data."""
    x = F.greatest(n, F.lit(1)).cast("double")
    stirling = (
        x * F.ln(x) - x + F.lit(0.5) * F.ln(F.lit(2 * math.pi) * x)
        + F.lit(1.0) / (F.lit(12.0) * x) - F.lit(1.0) / (F.lit(360.0) * x * x * x) + F.lit(1.0) / (F.lit(1260.0) * x * x * x * x * x)
    )
    return F.when(n < _SMALL, F.element_at(F.lit(_LOG_FACTORIALS), F.least(n, F.lit(_SMALL - 1)).cast("int") + 1)).otherwise(stirling)
