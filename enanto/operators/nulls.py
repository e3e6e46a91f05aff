"""Null models of paired readings by name, for whole tables of pairs.

Each takes pairs with case_id, t, domain, lat0, lon0, L, O_L, O_R, ``k`` (text that names the pair) and ``hour``, and gives
the same columns with values moved. The domain takes the place of the lead, the hour of day that of the instant (cases
don't share instants). Groups of any size are permuted as a whole, by ranks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knees import _candidates, _choose, KNEE, _seed
from .ordered import hash_ranks
from .pairing import with_domain
from .resampling import N_NULL, SEED, coin, key_of, per_series, shuffled
from ..session import written

GROUP = ["domain", "L"]
HOURLY = ["domain", "hour", "L"]


def keyed(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Pairs with what the null models need."""
    at = cases.where(F.col("case_id").isNotNull()).groupBy(F.col("case_id").alias("__at")).agg(F.min("lat0").alias("lat0"), F.min("lon0").alias("lon0"))
    p = with_domain(pairs, cases).join(at, F.col("case_id") == F.col("__at"), "left")
    return p.select("case_id", "t", "domain", "lat0", "lon0", F.hour("t").alias("hour"), "L", "O_L", "O_R", key_of(p).alias("k"))


def direction(p: DataFrame) -> DataFrame:
    """Both sides swapped by a fair coin each pair."""
    flip = coin(F.lit("dir"), F.col("k"))
    return p.withColumns({"O_L": F.when(flip, F.col("O_R")).otherwise(F.col("O_L")), "O_R": F.when(flip, F.col("O_L")).otherwise(F.col("O_R"))})


def _both_sides(p: DataFrame, by: list[str]) -> DataFrame:
    x = p
    for side in ("O_L", "O_R"):
        x = shuffled(x.withColumn("ks", F.concat(F.lit(f"{side}:"), F.col("k"))), by, side, "ks").drop("ks")
    return x


def spatial_shuffle(p: DataFrame) -> DataFrame:
    """Each side's values shuffled over the cases of a domain, hour and size."""
    return _both_sides(p, HOURLY)


def time_permutation(p: DataFrame) -> DataFrame:
    """Each side's values shuffled over all times of a domain and size."""
    return _both_sides(p, GROUP)


def fake_mirror(p: DataFrame) -> DataFrame:
    """Right sides shuffled over all pairs of a domain and size."""
    return shuffled(p, GROUP, "O_R", "k")


def _by_place(p: DataFrame, place: str, source_rank: Column) -> DataFrame:
    """Right sides moved along the pairs of a domain, hour and size in the order of ``place``; pairs without it stay."""
    here = written(p.where(F.col(place).isNotNull()), "placed")
    text = F.concat_ws(":", F.lit(str(SEED)), F.lit(place), F.col("k"))
    x = written(hash_ranks(here, HOURLY, text, "k", "r", (place,)), "placed-ranks")
    on = F.lit(True)
    for c in HOURLY:
        on = on & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    n = x.groupBy(*[F.col(c).alias(f"__s_{c}") for c in HOURLY]).agg(F.count("*").alias("n"))
    x = x.join(n, on).drop(*[f"__s_{c}" for c in HOURLY]).withColumn("from", source_rank)
    src = x.select(*[F.col(c).alias(f"__s_{c}") for c in HOURLY], F.col("r").alias("__r"), F.col("O_R").alias("__v"))
    moved = x.join(src, on & (F.col("from") == F.col("__r"))).withColumn("O_R", F.col("__v")).select(*p.columns)
    return moved.unionByName(p.where(F.col(place).isNull()))


def latitude_mirror(p: DataFrame) -> DataFrame:
    """Right sides of the northernmost and southernmost pairs exchanged, and so on inwards."""
    return _by_place(p, "lat0", F.col("n") + 1 - F.col("r"))


def longitude_shift(p: DataFrame) -> DataFrame:
    """Right sides moved one pair on along the longitude, the last one's to the first."""
    return _by_place(p, "lon0", F.when(F.col("r") == 1, F.col("n")).otherwise(F.col("r") - 1))


PAIR_NULLS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "direction": direction,
    "spatial_shuffle": spatial_shuffle,
    "time_permutation": time_permutation,
    "fake_mirror": fake_mirror,
    "latitude_mirror": latitude_mirror,
    "longitude_shift": longitude_shift,
}


def apply_null(name: str, pairs: DataFrame) -> DataFrame:
    """The pairs under a null model by its name, in any case and with spaces around it ignored."""
    key = name.strip().lower()
    if key not in PAIR_NULLS:
        raise ValueError(f"unknown null model {name!r}: {', '.join(PAIR_NULLS)}")
    return PAIR_NULLS[key](pairs)


def variants(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The pairs as they are (variant ``observed``) and under each null model, in one table."""
    base = written(pairs, "pairs")
    out = base.withColumn("variant", F.lit("observed"))
    for name in names:  # a fixed list of models
        out = out.unionByName(apply_null(name, base).withColumn("variant", F.lit(name)))
    return out


# -- models of single curves -------------------------------------------------------------------------------------------


def _time_shuffle(y: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    return y[np.argsort(rng.random((n, len(y))), axis=1)]


def _phase_scramble(y: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    f = np.fft.rfft(y)
    phase = rng.uniform(-math.pi, math.pi, (n, len(f)))
    phase[:, [0, -1]] = np.angle(f)[[0, -1]]
    return np.fft.irfft(np.abs(f) * np.exp(1j * phase), n=len(y), axis=1)


def _sign_flip(y: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Deviations from the curve's mean change sign by a fair coin: a size of contrast itself has no sign."""
    return y.mean() + (y - y.mean()) * rng.choice([-1.0, 1.0], (n, len(y)))


def _block_bootstrap(y: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    size = max(2, int(math.sqrt(len(y))))
    i = np.arange(len(y))
    start = rng.integers(0, max(1, len(y) - size + 1), (n, len(y) // size + 1))
    return y[np.minimum(start[:, i // size] + i % size, len(y) - 1)]


CURVE_NULLS = {"time_shuffle": _time_shuffle, "phase_scramble": _phase_scramble, "sign_flip": _sign_flip, "block_bootstrap": _block_bootstrap}


def curve_nulls(points: DataFrame, series: str, n: int = N_NULL, models: tuple[str, ...] = tuple(CURVE_NULLS), options: dict | None = None) -> DataFrame:
    """Each series of log points (columns L, y) under ``n`` replicates, replicate r by model r modulo their number.

    series, rep, model, gamma (slope of the replicate), L_k (its strongest admissible knee, null without one) and
    eta_mean; series of fewer than four sizes give no rows. All replicates of a series are fitted at once.
    """
    unknown = [m for m in models if m not in CURVE_NULLS]
    if unknown:
        raise ValueError(f"unknown null model {unknown[0]!r}: {', '.join(CURVE_NULLS)}")
    o = KNEE | (options or {})

    def one(key, L: np.ndarray, y: np.ndarray) -> dict:
        size = len(L)
        names = ("rep", "model", "gamma", "L_k", "eta_mean")
        if size < 4:
            return {c: [] for c in names}
        rng = np.random.default_rng(_seed(f"nulls:{key}"))
        rows = np.empty((n, size))
        for m, model in enumerate(models):
            at = np.arange(m, n, len(models))
            rows[at] = CURVE_NULLS[model](y, len(at), rng)
        x = np.broadcast_to(np.log(L), rows.shape)
        xc = x - x.mean(axis=1, keepdims=True)
        sxx = (xc * xc).sum(axis=1)
        gamma = np.where(sxx > 0, (xc * rows).sum(axis=1) / np.where(sxx > 0, sxx, 1.0), np.nan)
        least = max(o["min_side"], math.ceil(o["min_frac"] * size))
        ks = np.arange(max(least - 1, 1), min(size - least, size - 1))
        lk = [None] * n
        if len(ks):
            c = _candidates(x, rows, np.broadcast_to(L, rows.shape), ks, o)
            k, found = _choose(c, o["bic_delta_min"], o["knee_strength_min"])
            lk = [float(c["L"][r, k[r]]) if found[r] else None for r in range(n)]
        return dict(zip(names, (list(range(n)), [models[r % len(models)] for r in range(n)], gamma.tolist(), lk, np.exp(rows).mean(axis=1).tolist())))

    return per_series(points, series, "rep int, model string, gamma double, L_k double, eta_mean double", one, ("L", "y"))


def against_nulls(observed: DataFrame, nulls: DataFrame, series: str) -> DataFrame:
    """Per series the observed gamma, the mean and deviation of its nulls, p value of its size, and the share of nulls with a knee."""
    obs = observed.select(F.col(series).alias("__s"), F.col("gamma").alias("observed"))
    j = nulls.join(obs, F.col(series) == F.col("__s")).where("observed is not null")
    reach = F.abs("gamma") >= F.abs("observed")
    return j.groupBy(series, "observed").agg(
        F.avg("gamma").alias("null_mean"), F.stddev_pop("gamma").alias("null_std"), ((F.count_if(reach) + 1) / (F.count("gamma") + 1)).alias("p_value"), F.avg(F.col("L_k").isNotNull().cast("double")).alias("null_knee_rate"), F.count("*").alias("n_nulls")
    )
