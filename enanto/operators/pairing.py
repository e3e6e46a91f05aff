"""Mirror pairing: left and right readings of the same case, time and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LOG_FLOOR, finite

KEYS = ("case_id", "t", "L")


def fit_readings(samples: DataFrame) -> DataFrame:
    """Rows that can be paired: case_id, t, L, hand and O present, L and O finite, hand exactly L or R."""
    ok = F.col("case_id").isNotNull() & F.col("t").isNotNull() & finite(F.col("L")) & finite(F.col("O")) & F.col("hand").isin("L", "R")
    return samples.where(ok).select("sample_id", "load_id", "case_id", "t", "L", "hand", "O")


def contrast(left: Column, right: Column) -> dict[str, Column]:
    """eta, signed_parity, X_plus and X_minus of two sides; denominators below 1e-12 count as that."""
    half = (left + right) / 2.0
    floor = F.greatest(half, F.lit(LOG_FLOOR))
    return {"eta": F.abs(left - right) / floor, "signed_parity": (left - right) / floor, "X_plus": half, "X_minus": (left - right) / 2.0}


def sides(samples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per key with O_L, O_R (null where that side is missing) and the rows of each side.

    A pivot by conditional aggregation: one shuffle, combined on the map side. A side that comes more than once has the O
    of its lowest sample_id.
    """
    r = fit_readings(samples)

    def side(h: str) -> list[Column]:
        mine = F.col("hand") == h
        first = F.when(mine, F.coalesce("sample_id", F.lit(2**63 - 1)))
        return [F.min_by(F.when(mine, F.col("O")), first).alias(f"O_{h}"), F.count_if(mine).alias(f"n_{h}")]

    return r.groupBy(*keys).agg(*side("L"), *side("R"))


def pair_table(samples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Complete pairs with their contrast. Keys with one side only give no row; see :func:`unpaired`."""
    s = sides(samples, keys).where(F.col("O_L").isNotNull() & F.col("O_R").isNotNull())
    return s.select(*keys, "O_L", "O_R", *[c.alias(n) for n, c in contrast(F.col("O_L"), F.col("O_R")).items()])


def unpaired(samples: DataFrame) -> DataFrame:
    """Keys that have only one side, with the side that is missing."""
    s = sides(samples).where((F.col("n_L") == 0) | (F.col("n_R") == 0))
    return s.select(*KEYS, F.when(F.col("n_L") == 0, "L").otherwise("R").alias("missing_hand"))


def duplicate_keys(samples: DataFrame) -> DataFrame:
    """Keys and hands that come more than once."""
    return fit_readings(samples).groupBy(*KEYS, "hand").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def completeness(samples: DataFrame) -> DataFrame:
    """Per case: keys, complete ones and their share."""
    s = sides(samples)
    both = (F.col("n_L") > 0) & (F.col("n_R") > 0)
    return s.groupBy("case_id").agg(F.count("*").alias("n_keys"), F.count_if(both).alias("n_complete"), F.avg(both.cast("double")).alias("completeness"))


def with_domain(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Adds the case's domain (null where the case isn't listed); ``cases`` is joined as its size allows."""
    names = cases.where(F.col("case_id").isNotNull()).groupBy(F.col("case_id").alias("__case")).agg(F.min("domain").alias("domain"))
    return df.join(names, F.col("case_id") == F.col("__case"), "left").drop("__case")


def parity_energies(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean squares of the even and the odd part."""
    return pairs.groupBy(*by).agg(F.avg(F.col("X_plus") * F.col("X_plus")).alias("E_plus"), F.avg(F.col("X_minus") * F.col("X_minus")).alias("E_minus"), F.count("*").alias("n_pairs"))
