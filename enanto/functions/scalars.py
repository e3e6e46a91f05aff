"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_FLOOR = 1e-12


def finite(c: Column) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def null_nan(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(finite(c), c)


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a wall-clock column read as UTC, whatever the session's time zone.

    A zone-aware timestamp gives its instant; a zone-free one its wall clock, put together from its parts so that no
    session time zone enters; numbers pass through as microseconds.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        second = (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long")
        return (
            F.unix_date(c.cast("date")).cast("long") * F.lit(86_400_000_000)
            + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000)
            + second
        )
    return c.cast("long")


def safe_log(c: Column) -> Column:
    return F.log(F.greatest(c, F.lit(LOG_FLOOR)))


def safe_div(a: Column, b: Column, eps: float = LOG_FLOOR) -> Column:
    """a / b where denominators smaller than eps count as eps."""
    return a / F.when(F.abs(b) < eps, F.lit(eps)).otherwise(b)


def round_half_even(c: Column, step: float) -> Column:
    return F.rint(c / F.lit(float(step))) * F.lit(float(step))


def floor_to(c: Column, step: float) -> Column:
    return F.floor(c / F.lit(float(step))).cast("double") * F.lit(float(step))


def truthy(c: Column) -> Column:
    """true, 1 and yes in any case, spaces around them ignored; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))
