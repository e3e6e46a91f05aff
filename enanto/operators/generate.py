"""Synthetic contrasts over the sizes of real data: response models, signs, noise, label swaps and stress transforms.

Axes come from a table, draws from the md5 of seed and key; every transform is a column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resampling import coin, draw

WIDE = 16.0**7


def uniform(*key: Column) -> Column:
    """In (0, 1), from the key."""
    return (draw(*key) + 0.5) / WIDE


def axis(lo: float, hi: float, n: int, spacing: str = "linear") -> Column:
    """n values from lo to hi, evenly spaced or evenly spaced in the logarithm."""
    if n < 2:
        raise ValueError("an axis needs at least two values")
    if spacing == "log":
        if lo <= 0 or hi <= 0:
            raise ValueError("log spacing needs positive limits")
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.exp(math.log(lo) + k * ((math.log(hi) - math.log(lo)) / (n - 1))))
    if spacing != "linear":
        raise ValueError(f"unknown spacing {spacing!r}")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(lo) + k * ((hi - lo) / (n - 1)))


def _power(size: Column, a: float, gamma: float, l0: float = 1.0) -> Column:
    return a * F.pow(size / l0, F.lit(gamma))


def eta_models(size: Column, key: Column) -> dict[str, Column]:
    """The seven response models with their default parameters; only the forbidden band draws (from the key)."""
    xi = 40.0
    peak = 0.01 * xi
    base = 0.01 * 30.0**1.6
    slope = 0.2 + 1.9 * uniform(F.lit("slope"), key)
    shake = F.exp(0.35 * (uniform(F.lit("a"), key) + uniform(F.lit("b"), key) + uniform(F.lit("c"), key) - 1.5) * 2.0)
    return {
        "power_law": _power(size, 0.01, 1.0),
        "hybrid_knee": F.when(size <= xi, _power(size, 0.01, 1.0)).otherwise(peak * F.exp(-F.pow((size - xi) / (0.5 * xi), F.lit(2.0)))),
        "piecewise_forbidden": F.when(size < 30.0, _power(size, 0.01, 1.6)).when(size > 70.0, base * F.pow(size / 70.0, F.lit(0.7))).otherwise(base * F.pow(size / 30.0, slope) * shake),
        "eigen_stability": 0.01 * F.pow(size, F.element_at(F.array(F.lit(-0.5), F.lit(0.2), F.lit(1.0), F.lit(1.8)), (draw(F.lit("run"), key) % 4 + 1).cast("int"))),
        "dual_hybrid_knee": _power(size, 0.01, 1.4) * F.exp(-F.pow(size / 24.0, F.lit(2.0))) + _power(size, 0.008, 1.0) * F.exp(-F.pow(size / 70.0, F.lit(2.0))),
        "screened_power_law": _power(size, 0.02, 1.0) * F.exp(-F.pow(size / 30.0, F.lit(2.5))),
        "logistic_curve": 0.01 + 0.34 / (1.0 + F.exp(-(size - 40.0) / 8.0)),
    }


def noises(key: Column, scale: float = 0.02) -> dict[str, Column]:
    """Gaussian, lognormal, Laplace and Student's t (3 degrees) deviates of the scale, from the key."""

    def normal(tag: str) -> Column:
        return F.sqrt(-2.0 * F.log(uniform(F.lit(tag + "1"), key))) * F.cos(2.0 * math.pi * uniform(F.lit(tag + "2"), key))

    u = uniform(F.lit("l"), key) - 0.5
    z, a, b, c = (normal(t) for t in ("z", "p", "q", "r"))
    return {
        "gaussian": scale * z,
        "lognormal": F.exp(scale * z) - 1.0,
        "laplace": -scale / math.sqrt(2.0) * F.signum(u) * F.log(1.0 - 2.0 * F.abs(u)),
        "student_t": scale * z / F.sqrt((a * a + b * b + c * c) / 3.0),
    }


def coloured_noise(points: DataFrame, series: str, alpha: float = 1.0) -> DataFrame:
    """Noise with a 1/f^alpha power spectrum along each series, z-scored; 0 for fewer than 4 points."""
    import numpy as np

    from .knees import _seed
    from .resampling import per_series

    def one(key, i: np.ndarray) -> dict:
        n = len(i)
        noise = np.zeros(n)
        if n > 3:
            rng = np.random.default_rng(_seed(key))
            f = np.fft.rfftfreq(n)
            f[0] = f[1]
            x = np.fft.irfft((rng.normal(size=len(f)) + 1j * rng.normal(size=len(f))) * f ** (-alpha / 2), n=n)
            noise = (x - x.mean()) / max(x.std(), 1e-12)
        return {"i": i.astype(np.int64).tolist(), "noise": noise.tolist()}

    return per_series(points, series, "i long, noise double", one, ("i",))


def modelled(keys: DataFrame) -> DataFrame:
    """Long table (case_id, L, model, eta) of all models over the sizes of ``keys`` (case_id, L)."""
    k = F.concat_ws("|", F.col("case_id"), F.round(F.col("L") * 10_000).cast("long").cast("string"))
    models = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("eta")) for n, c in eta_models(F.col("L"), k).items()])
    return keys.select("case_id", "L", F.inline(models))


def synthetic_pairs(models: DataFrame, noise: float = 0.02, swap: float = 0.5) -> DataFrame:
    """Both sides around a baseline of 1: sign drawn per case, Laplace noise relative to each side, labels swapped at random.

    Sides are kept at 1e-8 or above.
    """
    k = F.concat_ws("|", F.col("case_id"), F.round(F.col("L") * 10_000).cast("long").cast("string"), F.col("model"))
    sign = F.when(coin(F.lit("sign"), F.col("case_id")), 1.0).otherwise(-1.0)

    def laplace(side: str) -> Column:
        u = uniform(F.lit(side), F.col("k")) - 0.5
        return -noise / math.sqrt(2.0) * F.signum(u) * F.log(1.0 - 2.0 * F.abs(u))

    x = models.withColumn("k", k).withColumn("sign", sign)
    left = F.greatest(F.lit(1e-8), (1.0 + F.col("sign") * F.col("eta") / 2.0) * (1.0 + laplace("L")))
    right = F.greatest(F.lit(1e-8), (1.0 - F.col("sign") * F.col("eta") / 2.0) * (1.0 + laplace("R")))
    swapped = uniform(F.lit("swap"), F.col("k")) < swap
    x = x.select("case_id", "L", "model", "eta", left.alias("first"), right.alias("second"), swapped.alias("swapped"))
    return x.select("case_id", "L", "model", "eta", F.when(F.col("swapped"), F.col("second")).otherwise(F.col("first")).alias("O_L"), F.when(F.col("swapped"), F.col("first")).otherwise(F.col("second")).alias("O_R"), "swapped")


def stressed(pairs: DataFrame, drift: float = 0.25, center: float = 40.0, width: float = 20.0, strength: float = 0.6, quantum_s: int = 3600, lost: float = 0.03) -> DataFrame:
    """Pairs after stress: baseline drift over the day, an even confound logistic in size, times floored to a quantum,
    sides exchanged above the centre size, and a random share of pairs lost."""
    from .resampling import key_of

    k = key_of(pairs)
    day = (F.hour("t") * 3600 + F.minute("t") * 60 + F.second("t")) / 86400.0
    gain = F.exp(drift * day) * (1.0 + F.greatest(F.lit(0.0), strength / (1.0 + F.exp(-(F.col("L") - center) / width))))
    flip = F.col("L") > center
    a, b = F.greatest(F.lit(1e-8), F.col("O_L") * gain), F.greatest(F.lit(1e-8), F.col("O_R") * gain)
    t = F.date_trunc("hour", "t").cast("timestamp_ntz") if quantum_s == 3600 else F.col("t")
    x = pairs.where(uniform(F.lit("lost"), k) >= lost)
    return x.select("case_id", t.alias("t"), "L", F.when(flip, b).otherwise(a).alias("O_L"), F.when(flip, a).otherwise(b).alias("O_R"))
