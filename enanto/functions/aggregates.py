"""Aggregates that stay bounded however large a group is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank error 1e-6: groups of less than about half a million values are exact, larger ones need no more memory.
ACCURACY = 1_000_000


def median(c: Column) -> Column:
    """Median as the mean of the lower and the upper one, each from a mergeable sketch; null values are left out."""
    return (F.percentile_approx(c, 0.5, ACCURACY) - F.percentile_approx(-c, 0.5, ACCURACY)) / 2.0


def std_or_zero(c: Column) -> Column:
    """Sample standard deviation; 0 for a single value."""
    return F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))


def rmse(c: Column) -> Column:
    return F.sqrt(F.avg(c * c))
