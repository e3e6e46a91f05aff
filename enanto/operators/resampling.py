"""Resampling nulls and bootstrap, keyed by hashes so that results don't depend on partitioning.

Draws come from md5 of seed, replicate and row key. Where a null shuffles values within a group, rows are ranked by two
hashes of their keys and matched rank to rank: a permutation of the whole group, and no group is ever sorted in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import hash_ranks
from .pairing import contrast
from ..functions.aggregates import median
from ..functions.scalars import LOG_FLOOR
from ..session import apply_groups, kernel_partitions, map_arrow, written

SEED = 42
#: The same in the kernels at the reference's counts: groups up to this size are permuted as a whole.
KERNEL_BLOCK = 1_000_000
# The reference's counts and limits.
N_PERM, N_NULL, N_SLOPES = 200, 200, 2000
ALPHA, ETA_MIN, DIRECTION_MIN = 0.05, 0.03, 0.30


def draw(*key: Column, digits: int = 7) -> Column:
    """A whole number below 16^digits from the md5 of the key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), *[k.cast("string") for k in key])), 1, digits), 16, 10).cast("long")


def coin(*key: Column) -> Column:
    return draw(*key) % 2 == 1


def replicates(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def key_of(df: DataFrame) -> Column:
    """Text that names a pair: case, epoch microseconds of t, and size with four decimals."""
    from ..functions.scalars import epoch_micros

    return F.concat_ws("|", F.col("case_id"), epoch_micros(df, "t").cast("string"), F.round(F.col("L") * 10_000).cast("long").cast("string"))


def sign_flip(pairs: DataFrame) -> DataFrame:
    """Pairs with signed parity negated by a fair coin each; eta doesn't change."""
    k = key_of(pairs)
    flip = coin(k)
    return pairs.select("case_id", "t", "L", "eta", F.when(flip, -F.col("signed_parity")).otherwise(F.col("signed_parity")).alias("signed_parity"), flip.alias("flipped"))


def mirror_swap(readings: DataFrame) -> DataFrame:
    """Readings whose hand is flipped row by row by a fair coin; a key may then hold one hand twice."""
    other = F.when(F.col("hand") == "L", "R").otherwise("L")
    return readings.select("sample_id", "case_id", "t", "L", F.when(coin(F.col("sample_id")), other).otherwise(F.col("hand")).alias("hand"), "O")


def direction_null(pairs: DataFrame, by: list[str], n: int = 50) -> DataFrame:
    """Per group the observed |mean sign| and the share of replicates with random swaps that reach it, (1 + #) / (n + 1)."""
    x = replicates(pairs.withColumn("k", key_of(pairs)).withColumn("s", F.signum("signed_parity")), n)
    m = x.groupBy(*by, "rep").agg(F.abs(F.avg(F.when(coin(F.col("rep"), F.col("k")), -F.col("s")).otherwise(F.col("s")))).alias("m"), F.abs(F.avg("s")).alias("obs"))
    return m.groupBy(*by).agg(F.max("obs").alias("obs_dir"), ((F.count_if(F.round("m", 9) >= F.round("obs", 9)) + 1) / F.lit(n + 1)).alias("p_dir"))


def shuffled(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """``value`` permuted within each group of ``by`` (which names the replicate too), uniformly whatever the group's size.

    The rows ranked by one hash of their keys take the values of the rows ranked by another, in parts
    (:func:`.ordered.hash_ranks`). Curves are permuted in a kernel instead (:func:`null_slopes`).
    """
    label = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by if c == "rep"]
    to, source = F.concat_ws(":", F.lit(str(SEED)), F.lit("to"), F.col(key)), F.concat_ws(":", F.lit(str(SEED)), *label, F.col(key))
    x = hash_ranks(hash_ranks(written(df, "shuffled"), by, to, key, "__to"), by, source, key, "__from")
    x = written(x, "ranked")
    source = x.select(*[F.col(c).alias(f"__s_{c}") for c in by], F.col("__from").alias("__i"), F.col(value).alias("__v"))
    on = F.col("__to") == F.col("__i")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    return x.join(source, on).withColumn(value, F.col("__v")).select(*df.columns)


def permutation_null(pairs: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """Per group the observed median eta and the share of replicates, O_R shuffled within group and size, that reach it."""
    x = replicates(pairs.select(*by, "L", "O_L", "O_R", key_of(pairs).alias("k")), n)
    y = shuffled(x, [*by, "L", "rep"], "O_R", "k")
    m = y.groupBy(*by, "rep").agg(median(contrast(F.col("O_L"), F.col("O_R"))["eta"]).alias("m"))
    obs = pairs.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(median(F.col("eta")).alias("mirror_stat"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    j = m.join(obs, on)
    return j.groupBy(*by, "mirror_stat").agg(((F.count_if(F.round("m", 9) >= F.round("mirror_stat", 9)) + 1) / F.lit(n + 1)).alias("p_perm"))


def time_shuffle(readings: DataFrame) -> DataFrame:
    """Readings whose O is shuffled within the case, over sizes and hands alike."""
    return shuffled(readings.select("sample_id", "case_id", "t", "L", "hand", "O").withColumn("k", F.lpad(F.col("sample_id").cast("string"), 20, "0")), ["case_id"], "O", "k").drop("k")


def bootstrap_slopes(points: DataFrame, series: str, n: int = 50, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the least-squares slope over n resamples of each series' points (some tens each)."""
    x = replicates(points.select(series, "i", "n_points"), n)
    x = x.withColumn("j", draw(F.col(series), F.col("rep"), F.col("i")) % F.col("n_points"))
    src = points.select(F.col(series).alias("__s"), F.col("i").alias("__i"), "x", "y")
    j = x.join(src, (F.col(series) == F.col("__s")) & (F.col("j") == F.col("__i")))
    slope = j.groupBy(series, "rep").agg(F.regr_slope("y", "x").alias("slope"))
    q = F.percentile("slope", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return slope.where("slope is not null").groupBy(series).agg(F.count("*").alias("n_reps"), q.alias("q")).select(series, "n_reps", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))


def block_bootstrap(points: DataFrame, series: str, n: int = 10) -> DataFrame:
    """Per series and replicate the mean y of a moving-block resample; blocks of max(2, floor(sqrt(n_points))) points.

    Blocks start at random places and are laid end to end until the series' length is reached.
    """
    size = F.greatest(F.lit(2), F.floor(F.sqrt(F.col("n_points").cast("double"))).cast("int"))
    x = replicates(points.select(series, "i", "n_points"), n).withColumn("b", size)
    start = draw(F.col(series), F.col("rep"), F.floor(F.col("i") / F.col("b")).cast("long")) % F.greatest(F.lit(1), F.col("n_points") - F.col("b") + 1)
    x = x.withColumn("j", F.least(start + F.col("i") % F.col("b"), F.col("n_points") - 1))
    src = points.select(F.col(series).alias("__s"), F.col("i").alias("__i"), "y")
    return x.join(src, (F.col(series) == F.col("__s")) & (F.col("j") == F.col("__i"))).groupBy(series, "rep").agg(F.avg("y").alias("mean_y"), F.count("*").alias("n"))


def reversed_series(points: DataFrame, series: str) -> DataFrame:
    """Each point with the y of its mirror image in the series' order, and with that of the point before it in a circle."""
    src = points.select(F.col(series).alias("__s"), F.col("i").alias("__i"), F.col("y").alias("y_reversed"))
    j = points.join(src, (F.col(series) == F.col("__s")) & (F.col("n_points") - 1 - F.col("i") == F.col("__i")))
    w = Window.partitionBy(series).orderBy("i")
    rolled = F.coalesce(F.lag("y").over(w), F.last("y").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return j.select(series, "i", "y", "y_reversed", rolled.alias("y_rolled"))


def moving_averages(points: DataFrame, series: str, window: int = 5) -> DataFrame:
    """Centred means of y: over full windows only, over what there is of three, and with zeros beyond the ends."""
    half = window // 2
    o = Window.partitionBy(series).orderBy("i")
    wide, three = o.rowsBetween(-half, half), o.rowsBetween(-1, 1)
    return points.select(
        series,
        "i",
        F.when(F.count("y").over(wide) == 2 * half + 1, F.avg("y").over(wide)).alias("rolling"),
        F.avg("y").over(three).alias("rolling_three"),
        (F.sum("y").over(wide) / float(2 * half + 1)).alias("convolved"),
    )


def scaled(points: DataFrame, series: str, eps: float = 1e-12) -> DataFrame:
    """z-score (population deviation) and min-max position of y; 0 where the series doesn't vary."""
    w = Window.partitionBy(series)
    sd, lo, hi = F.stddev_pop("y").over(w), F.min("y").over(w), F.max("y").over(w)
    z = F.when(sd < eps, 0.0).otherwise((F.col("y") - F.avg("y").over(w)) / sd)
    return points.select(series, "i", z.alias("zscore"), F.when(hi - lo < eps, 0.0).otherwise((F.col("y") - lo) / (hi - lo)).alias("minmax"))


# -- kernels at the reference's counts ---------------------------------------------------------------------------------


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(":".join(map(str, (SEED, *key))).encode()))


def _eta(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.abs(left - right) / np.maximum((left + right) / 2.0, LOG_FLOOR)


def parity_significance(pairs: DataFrame, by: str, n: int = N_PERM, alpha: float = ALPHA, eta_min: float = ETA_MIN, direction_min: float = DIRECTION_MIN) -> DataFrame:
    """Per group median eta and |mean sign| against ``n`` permutations of O_R within each size and ``n`` rounds of random swaps.

    Each task permutes whole sizes of a group (blocks of about ``KERNEL_BLOCK`` pairs of larger ones) and gives one row a
    replicate: a median reaches the observed one by the number of eta at or above that and, where exactly half are, by
    the two next to it, and those add up over sizes. So no permuted value is shuffled. p is (1 + #) / (n + 1).
    """
    obs = pairs.groupBy(F.col(by).alias("__by")).agg(median(F.col("eta")).alias("mirror_stat"))
    x = pairs.select(by, "L", "O_L", "O_R", key_of(pairs).alias("k"))
    sizes = x.groupBy(F.col(by).alias("__n_by"), F.col("L").alias("__n_L")).agg(F.ceil(F.count("*") / KERNEL_BLOCK).alias("__blocks"))
    x = x.join(sizes, F.col(by).eqNullSafe(F.col("__n_by")) & (F.col("L") == F.col("__n_L"))).withColumn("b", F.pmod(F.xxhash64("k"), F.col("__blocks")))
    x = x.join(obs, F.col(by).eqNullSafe(F.col("__by")))
    x = x.select(by, "L", "b", "O_L", "O_R", F.xxhash64("k").alias("h"), "mirror_stat")
    kind = pairs.schema[by].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "O_L", "O_R"])
        left, right, stat = pdf["O_L"].to_numpy(float), pdf["O_R"].to_numpy(float), float(pdf["mirror_stat"].iloc[0])
        sign = np.sign(left - right).astype(np.int8)
        rng = _rng("parity", *key)
        out = {c: [] for c in ("reach", "above", "below", "swapped")}
        for _ in range(n):
            e = _eta(left, right[rng.permutation(len(right))])
            up = e >= stat
            out["reach"].append(int(up.sum()))
            out["above"].append(float(e[up].min()) if up.any() else None)
            out["below"].append(float(e[~up].max()) if not up.all() else None)
            swap = np.unpackbits(np.frombuffer(rng.bytes((len(left) + 7) // 8), np.uint8), count=len(left)).view(bool)
            out["swapped"].append(int(np.where(swap, -sign, sign).sum(dtype=np.int64)))
        return pd.DataFrame({by: key[0], "rep": np.arange(n), "n": len(left), "dir": int(sign.sum(dtype=np.int64)), **{c: pd.array(v, "Float64" if c in ("above", "below") else "Int64") for c, v in out.items()}})

    r = apply_groups(x, [by, "L", "b"], one, f"`{by}` {kind}, rep int, n long, dir long, reach long, above double, below double, swapped long")
    m = r.groupBy(by, "rep").agg(*[F.sum(c).alias(c) for c in ("n", "dir", "reach", "swapped")], F.min("above").alias("above"), F.max("below").alias("below"))
    m = m.join(obs, F.col(by).eqNullSafe(F.col("__by")))
    twice, stat = 2 * F.col("reach"), F.col("mirror_stat")
    as_large = (twice > F.col("n")) | ((twice == F.col("n")) & ((F.col("above") + F.col("below")) / 2.0 >= stat))
    p = lambda c: (F.count_if(c) + 1) / F.lit(n + 1)
    g = m.groupBy(by, "mirror_stat").agg(F.max("n").alias("n_pairs"), F.max(F.abs("dir") / F.col("n")).alias("obs_dir"), p(as_large).alias("p_perm"), p(F.abs("swapped") >= F.abs("dir")).alias("p_dir"))
    mirror, direction = (F.col("p_perm") < alpha) & (stat >= eta_min), (F.col("p_dir") < alpha) & (F.col("obs_dir") >= direction_min)
    return g.select(by, "n_pairs", "mirror_stat", "obs_dir", "p_perm", "p_dir", mirror.alias("mirror_pass"), direction.alias("direction_pass"), (mirror | direction).alias("signal_pass"))


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def per_series(points: DataFrame, series: str, fields: str, one, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Rows (a dict of lists) that ``one(key, *columns)`` makes of each series' points in their order; many series a task.

    Points are ordered by the column ``i``, or by the columns themselves where there is none; null becomes NaN.
    """
    kind = points.schema[series].dataType.simpleString()
    order = ["i"] if "i" in points.columns and "i" not in columns else []
    curves = points.groupBy(series).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("p"))  # one curve
    names, kinds = zip(*(f.split() for f in fields.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = {c: [] for c in (series, *names)}
            for key, p in zip(b[series].to_pylist(), b["p"].to_pylist()):
                got = one(key, *(np.array([e[c] for e in p], float) for c in columns))
                kept[series] += [key] * len(got[names[0]])
                for c in names:
                    kept[c] += list(got[c])
            types = [b.schema.field(series).type, *[_ARROW[k] for k in kinds]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(kept.values(), types)], names=[series, *names])

    return map_arrow(curves.repartition(kernel_partitions(points.sparkSession), series), run, f"`{series}` {kind}, {fields}")


def _slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least-squares slope of each row; NaN where x doesn't vary."""
    dx = x - x.mean(axis=1, keepdims=True)
    flat = (x == x[:, :1]).all(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = (dx * (y - y.mean(axis=1, keepdims=True))).sum(axis=1) / (dx * dx).sum(axis=1)
    g[flat] = np.nan
    return g


def slope_intervals(points: DataFrame, series: str, n: int = N_SLOPES, alpha: float = ALPHA) -> DataFrame:
    """:func:`bootstrap_slopes` at the reference's count, all resamples of a series at once."""

    def one(key, x, y):
        j = _rng("slopes", key).integers(0, len(x), (n, len(x)))
        g = _slopes(x[j], y[j])
        g = g[~np.isnan(g)]
        if not len(g):
            return {"n_reps": [], "lo": [], "hi": []}
        lo, hi = np.quantile(g, [alpha / 2, 1 - alpha / 2])
        return {"n_reps": [len(g)], "lo": [float(lo)], "hi": [float(hi)]}

    return per_series(points, series, "n_reps long, lo double, hi double", one)


def gamma_significance(points: DataFrame, series: str, n: int = N_NULL) -> DataFrame:
    """Slope of each series against slopes with y shuffled over its sizes, at the reference's count of nulls."""

    def one(key, x, y):
        gamma = _slopes(x[None], y[None])[0]
        if np.isnan(gamma):
            return {c: [None] for c in ("gamma", "null_mean", "p_value")}
        order = np.argsort(_rng("gamma", key).random((n, len(x))), axis=1)
        g = _slopes(np.broadcast_to(x, order.shape), y[order])
        reach = int((np.abs(np.round(g, 9)) >= np.abs(np.round(gamma, 9))).sum())
        return {"gamma": [float(gamma)], "null_mean": [float(g.mean())], "p_value": [(reach + 1) / (n + 1)]}

    return per_series(points, series, "gamma double, null_mean double, p_value double", one)


def _md5_orders(before: list[str], keys: list[bytes]) -> np.ndarray:
    """A row for each text put before the keys: their order by md5, ties in the order given."""
    heads = [b.encode() for b in before]
    h = b"".join(hashlib.md5(b + k, usedforsecurity=False).digest() for b in heads for k in keys)
    h = np.frombuffer(h, ">u8").astype(np.uint64).reshape(len(heads), len(keys), 2)
    return np.lexsort((h[..., 1], h[..., 0]), axis=-1)


def null_slopes(points: DataFrame, series: str, n: int = 20, most: int = 1_000_000) -> DataFrame:
    """Slope of each series against slopes over ``n`` shuffles of y that SQL can repeat: :func:`shuffled` in a kernel.

    The ranks by both hashes are made where a curve's points are, so no replicate is ever a row: Spark's estimates don't
    count repeats by ``explode`` and took such a table for one to broadcast. Replicates of at most ``most`` points at a time.
    A series of one size has NaN for slopes and a p of 1, as in SQL.
    """

    def one(key, x, y):
        keys = [f"{key}:{str(i).zfill(6)[:6]}".encode() for i in range(len(x))]
        to = _md5_orders([f"{SEED}:to:"], keys)[0]
        step, g = max(1, most // len(x)), []
        for lo in range(0, n, step):
            source = _md5_orders([f"{SEED}:{rep}:" for rep in range(lo, min(n, lo + step))], keys)
            z = np.empty(source.shape)
            z[:, to] = y[source]
            g.append(_slopes(np.tile(x, (len(z), 1)), z))
        g, gamma = np.concatenate(g), _slopes(x[None], y[None])
        nine = lambda v: np.floor(np.abs(v) * 1e9 + 0.5)
        reach = int((~(nine(g) < nine(gamma))).sum())  # NaN reaches NaN
        return {"gamma": [float(gamma[0])], "null_mean": [float(g.mean())], "p_value": [(reach + 1) / (n + 1)]}

    return per_series(points, series, "gamma double, null_mean double, p_value double", one)


def block_means(points: DataFrame, series: str, n: int = N_NULL) -> DataFrame:
    """:func:`block_bootstrap` at the reference's count of nulls."""

    def one(key, x, y):
        size = max(2, int(np.sqrt(len(y))))
        i = np.arange(len(y))
        start = _rng("blocks", key).integers(0, max(1, len(y) - size + 1), (n, len(y) // size + 1))
        j = np.minimum(start[:, i // size] + i % size, len(y) - 1)
        return {"rep": range(n), "mean_y": y[j].mean(axis=1).tolist(), "n": [len(y)] * n}

    return per_series(points, series, "rep int, mean_y double, n long", one)
