"""Scalar and aggregate column helpers.

NULL is the only missing value inside the library: NaN and infinities are
turned into NULL on ingest, and every division is a ``try_divide`` so that a
zero denominator yields NULL under ANSI mode instead of an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is zero or either side is missing."""
    return F.try_divide(col(a), col(b))


def is_infinite(x: str | Column) -> Column:
    return F.abs(col(x)) == F.lit(float("inf"))


def finite(x: str | Column) -> Column:
    """NULL in place of NaN and both infinities."""
    x = col(x)
    return F.when(F.isnan(x) | is_infinite(x), None).otherwise(x)


def scratch(taken: Sequence[str], *names: str) -> list[str]:
    """Names for working columns that no column in ``taken`` has."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + n for n in names]


# ------------------------------------------------------------- aggregates


def mean_when(condition: Column, value: Column | None = None) -> Column:
    """Mean of ``value`` (default: the condition as 0/1) over rows that qualify.

    With one argument it is the share of true among rows where the condition is
    known; with two it averages ``value`` where the condition holds.
    """
    if value is None:
        return F.avg(condition.cast("double"))
    return F.avg(F.when(condition, value))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over pairwise complete rows; NULL on a constant side.

    The built-in ``corr`` raises under ANSI mode when one side is constant.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(
        F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py)
    )


def sample_skew(x: str | Column) -> Column:
    """Bias-corrected skewness; 0 for a constant series, NULL below 3 values."""
    x = col(x)
    n = F.count(x).cast("double")
    scaled = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.var_pop(x) == 0, 0.0).otherwise(scaled)


def sample_kurtosis(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant, NULL below 4 values."""
    x = col(x)
    n = F.count(x).cast("double")
    scaled = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n < 4, None).when(F.var_pop(x) == 0, 0.0).otherwise(scaled)
