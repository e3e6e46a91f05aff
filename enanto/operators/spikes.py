"""Problem 3: implausible spikes in measurements.

A series is one (case_id, L, hand) ordered by t. Each is decomposed robustly into a running-median trend, the median of
the detrended readings by hour of day (where it spans at least two days) and a remainder. Remainders beyond the
generalised extreme studentised deviate limits, with mean and deviation taken anew after each removal, are candidates; an
exact check of the readings before and after confirms them. Range and constant-run checks are separate.

A task holds many series at once and works on them with segmented NumPy operations. A series of more than ``CHUNK``
readings is cut into chunks by running counts over narrow time buckets; chunks overlap by enough readings to judge each
reading in its own chunk as in the whole. What such a series needs as a whole (usual scatter, daily cycle, ranks and sums
of its remainders) comes exactly from all its readings, so the rule is the same whatever a series' length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import exact_medians, ranked
from ..functions.scalars import epoch_micros
from ..session import kernel_partitions, map_arrow, with_small, written

# Limits fixed by the problem statement.
STUCK_RUN = 10
SPIKE_RUN = 3
SIDE_LEAST = 3
SERIES_LEAST = 40
SCATTERS = 12.0

SIDE = 5  # readings whose median is the level before or after
TREND = 7  # readings of the running median; more than twice the longest spike
MAD = 1.4826  # median absolute deviation to standard deviation of a normal
ALPHA = 0.05
TESTED = 4  # at most a quarter of a series can be extreme
DAY_US = 86_400_000_000
BINS = 24
CYCLE_US = 2 * DAY_US  # a daily cycle needs two days
CYCLE_LEAST = 4 * BINS  # and more readings than this
HOUR_LEAST = 2 * SPIKE_RUN  # and more in its hour, so that one spike can't become its own cycle
CHUNK = 100_000
HALO = 16  # readings seen beyond a chunk on either side; at least STUCK_RUN - 1 and SPIKE_RUN + SIDE
BUCKET_STEPS = 64
SUPER = 4096
FALLBACK_STEP_S = 3600
BATCH = 150_000

_SERIES = ["case_id", "L", "hand"]
_OUT = "case_id string, L double, hand string, us long, first_id long, last_id long, n_rows long, kind string, dev double, d double"


@lru_cache(maxsize=1)
def _normal_tail() -> tuple[np.ndarray, np.ndarray]:
    grid = np.linspace(0.0, 9.0, 4001)
    return grid, np.array([0.5 * math.erfc(z / math.sqrt(2)) for z in grid])


def _t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student's t quantile from the normal one (Cornish-Fisher terms to df^-3)."""
    grid, tail = _normal_tail()
    z = np.interp(-np.log(np.maximum(1 - p, tail[-1])), -np.log(tail), grid)
    z3, z5, z7 = z**3, z**5, z**7
    return z + (z3 + z) / (4 * df) + (5 * z5 + 16 * z3 + 3 * z) / (96 * df**2) + (3 * z7 + 19 * z5 + 17 * z3 - 15 * z) / (384 * df**3)


def gesd_limits(n: np.ndarray, i: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Limit of the i-th most extreme of n studentised deviates (i from 1)."""
    n, i = np.asarray(n, float), np.asarray(i, float)
    df = np.maximum(n - i - 1, 1.0)
    t = _t_quantile(1 - alpha / (2 * np.maximum(n - i + 1, 1.0)), df)
    return (n - i) * t / np.sqrt((df + t * t) * np.maximum(n - i + 1, 1.0))


def _window(x: np.ndarray, seg: np.ndarray, offsets: range) -> tuple[np.ndarray, np.ndarray]:
    """Median of the readings at the offsets within the same segment, and how many there are."""
    n = len(x)
    w = np.full((n, len(offsets)), np.nan)
    for k, d in enumerate(offsets):
        a, b = max(0, -d), min(n, n - d)
        if a < b:
            same = seg[a:b] == seg[a + d : b + d]
            w[a:b, k] = np.where(same, x[a + d : b + d], np.nan)
    w.sort(axis=1)
    count = (~np.isnan(w)).sum(axis=1)
    c = np.maximum(count, 1)
    rows = np.arange(n)
    return (w[rows, (c - 1) // 2] + w[rows, c // 2]) / 2, count


def _segment_median(x: np.ndarray, seg: np.ndarray, n_seg: int) -> np.ndarray:
    """Median of x per segment; NaN where a segment has none."""
    order = np.lexsort((x, seg))
    count = np.bincount(seg, minlength=n_seg)
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    out = np.full(n_seg, np.nan)
    some = count > 0
    s = x[order]
    lo, hi = start[some] + (count[some] - 1) // 2, start[some] + count[some] // 2
    out[some] = (s[lo] + s[hi]) / 2
    return out


def _cells(us: np.ndarray) -> np.ndarray:
    return (us % DAY_US) * BINS // DAY_US


def _daily_cycle(us: np.ndarray, d: np.ndarray, seg: np.ndarray, n_seg: int) -> np.ndarray:
    """Median of the detrended readings per series and hour of day; zero for series shorter than two days."""
    first = np.searchsorted(seg, np.arange(n_seg))
    last = np.searchsorted(seg, np.arange(n_seg), side="right") - 1
    cyclic = (us[last] - us[first] >= CYCLE_US) & (last - first >= CYCLE_LEAST)
    out = np.zeros(len(d))
    rows = np.flatnonzero(cyclic[seg])
    if len(rows):
        cell = seg[rows] * BINS + _cells(us[rows])
        med = np.nan_to_num(_segment_median(d[rows], cell, n_seg * BINS))
        med[np.bincount(cell, minlength=n_seg * BINS) <= HOUR_LEAST] = 0.0
        out[rows] = med[cell]
    return out


def _extreme(n: np.ndarray, below: np.ndarray, c: np.ndarray, v: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Rank of each remainder v (from the largest, 1) where it is beyond its generalised ESD limit, else 0.

    The deviate is studentised by mean and deviation of what remains when all larger remainders are removed (s1 and s2
    are the sums up to v); equal remainders have one rank. At most one in ``TESTED`` readings of a series is tested.
    """
    left = (below + c).astype(float)
    rank = n - left + 1
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        mean = s1 / left
        # Of a remainder so large that its square isn't finite the deviate can't be told from the largest possible one.
        var = (s2 - s1 * mean) / (left - 1)
        deviate = np.where(np.isfinite(s2), np.maximum(np.abs(v - mean), np.abs(v + mean)) / np.sqrt(np.maximum(var, 0.0)), (left - 1) / np.sqrt(left))
        beyond = (rank <= n // TESTED) & (v > 0) & (left >= 3) & (deviate > gesd_limits(n, rank))
    return np.where(beyond, rank, 0).astype(np.int64)


def candidates(r: np.ndarray, seg: np.ndarray, n_seg: int) -> np.ndarray:
    """Which remainders are beyond the generalised ESD limits of their series: all down to the last one that is."""
    v = np.abs(r)
    order = np.lexsort((v, seg))
    vs, gs, rs = v[order], seg[order], r[order]
    count = np.bincount(seg, minlength=n_seg)
    start = np.concatenate(([0], np.cumsum(count)))
    s1, s2 = rs.copy(), rs * rs
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        # Series by series, small remainders first, so that no large one costs the others their digits.
        if b - a > 1:
            np.cumsum(s1[a:b], out=s1[a:b])
            np.cumsum(s2[a:b], out=s2[a:b])
    end = np.ones(len(vs), bool)  # the last of equal remainders has the sums
    end[:-1] = (vs[1:] != vs[:-1]) | (gs[1:] != gs[:-1])
    e = np.flatnonzero(end)
    n = count[gs[e]]
    upto = e + 1 - start[gs[e]]
    rank = _extreme(n, upto - 1, np.ones(len(e)), vs[e], s1[e], s2[e])
    worst = np.zeros(n_seg, np.int64)
    np.maximum.at(worst, gs[e], rank)
    # Rank of every remainder: one more than the number of larger ones.
    group = np.cumsum(np.concatenate(([0], end[:-1].astype(np.int64))))
    mine = (n - upto + 1)[group]
    out = np.zeros(len(r), bool)
    out[order] = (mine <= worst[gs]) & (mine > 0)
    return out


def judge(us: np.ndarray, x: np.ndarray, seg: np.ndarray) -> dict[str, np.ndarray]:
    """Per reading what its neighbours tell: stuck, deviation ``dev`` beyond both levels, and ``d``, the reading less its trend.

    ``seg`` numbers the series or chunks in order from 0; readings are in order of time within each.
    """
    n = len(x)
    new = np.ones(n, bool)
    new[1:] = (x[1:] != x[:-1]) | (seg[1:] != seg[:-1])
    run = np.cumsum(new) - 1
    stuck = np.bincount(run)[run] >= STUCK_RUN
    level, _ = _window(x, seg, range(-(TREND // 2), TREND // 2 + 1))

    before, n_before = _window(x, seg, range(-SIDE, 0))
    after, n_after = _window(x, seg, range(1, SIDE + 1))
    dev = np.full(n, -np.inf)
    for w in range(1, SPIKE_RUN + 1):
        if n < w + 2 * SIDE_LEAST:
            break
        i = np.arange(1, n - w)
        j = i + w - 1
        ok = (seg[i] == seg[j]) & (n_before[i] >= SIDE_LEAST) & (n_after[j] >= SIDE_LEAST)
        i, j = i[ok], j[ok]
        inside = np.stack([x[i + k] for k in range(w)])
        still = np.any([stuck[i + k] for k in range(w)], axis=0)
        high, low = np.maximum(before[i], after[j]), np.minimum(before[i], after[j])
        up, down = inside.min(axis=0) - high, low - inside.max(axis=0)
        # The readings next to the run belong to the levels, else the run is longer than this.
        up[np.maximum(x[i - 1], x[j + 1]) - high > 0.5 * up] = -np.inf
        down[low - np.minimum(x[i - 1], x[j + 1]) > 0.5 * down] = -np.inf
        d = np.where(still, -np.inf, np.maximum(up, down))
        for k in range(w):
            np.maximum.at(dev, i + k, d)
    return {"stuck": stuck, "dev": dev, "d": x - level}


def _spikes(us: np.ndarray, seg: np.ndarray, r: dict[str, np.ndarray]) -> np.ndarray:
    """Readings of whole series that are candidates by their remainder and that the exact check confirms."""
    n_seg = int(seg[-1]) + 1
    moving = np.flatnonzero(~r["stuck"])
    scatter = MAD * _segment_median(np.abs(r["d"][moving]), seg[moving], n_seg)
    remainder = r["d"] - _daily_cycle(us, r["d"], seg, n_seg)
    candidate = np.zeros(len(us), bool)
    candidate[moving] = candidates(remainder[moving], seg[moving], n_seg)
    return candidate & (np.bincount(seg)[seg] >= SERIES_LEAST) & (r["dev"] > SCATTERS * scatter[seg])


def _judged(table: pa.Table) -> pa.Table:
    """Flagged readings of whole series, and all readings of chunked ones with what their series' judgement needs."""
    cols = {c: table[c].combine_chunks() for c in (*_SERIES, "chunk")}
    n = len(table)
    new = np.ones(n, bool)
    if n > 1:
        diff = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in cols.values()]
        new[1:] = np.any(diff, axis=0)
    seg = np.cumsum(new) - 1
    us, x = (table[c].to_numpy() for c in ("us", "o"))
    own, hot = (table[c].to_numpy().astype(bool) for c in ("own", "hot"))
    r = judge(us, x, seg)
    spike = ~hot & _spikes(us, seg, r) if not hot.all() else np.zeros(n, bool)
    keep = np.flatnonzero(own & (hot | spike | r["stuck"]))
    kind = np.where(hot[keep], np.where(r["stuck"][keep], "pending stuck", "pending"), np.where(r["stuck"][keep], "stuck", "spike"))
    out = table.select([*_SERIES, "us", "first_id", "last_id", "n_rows"]).take(pa.array(keep))
    for name, v in (("kind", pa.array(kind.tolist(), pa.string())), ("dev", pa.array(r["dev"][keep])), ("d", pa.array(r["d"][keep]))):
        out = out.append_column(name, v)
    return out


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Series arrive whole and in order; what a batch cuts is carried over to the next."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(t):
            yield from _judged(t).to_batches()

    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows < BATCH:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(len(t), bool)
        for c in (*_SERIES, "chunk"):
            same &= pc.equal(t[c], t[c][-1]).to_numpy()
        cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
        yield from done(t.slice(0, cut))
        held, rows = t.slice(cut).to_batches(), len(t) - cut
    if held:
        yield from done(pa.Table.from_batches(held).combine_chunks())


def _eligible(samples: DataFrame, cases: DataFrame, domains: DataFrame) -> DataFrame:
    """Rows that can be judged, with ``impossible`` and the case's step."""
    bounds = domains.groupBy(F.col("domain").alias("__domain")).agg(F.min("o_min").alias("o_min"), F.max("o_max").alias("o_max"))
    known = cases.where(F.col("case_id").isNotNull()).groupBy(F.col("case_id").alias("__case")).agg(F.min("domain").alias("domain"), F.min("step_s").alias("step_s"))
    known = known.join(bounds, F.col("domain") == F.col("__domain"), "left").select("__case", "step_s", "o_min", "o_max")
    rows = samples.where(
        F.col("case_id").isNotNull()
        & F.col("t").isNotNull()
        & F.col("L").isNotNull()
        & ~F.isnan("L")
        & F.col("O").isNotNull()
        & ~F.isnan("O")
        & F.col("hand").isin("L", "R")
    ).select("sample_id", "case_id", "L", "hand", epoch_micros(samples, "t").alias("us"), F.col("O").alias("o"))
    out = with_small(rows, known, "case_id", "__case", F.col("us"))
    bad = F.coalesce((F.col("o") < F.col("o_min")) | (F.col("o") > F.col("o_max")), F.lit(False)) | (F.abs("o") == float("inf"))
    return out.withColumn("impossible", bad)


def _hot_buckets(readings: DataFrame, hot: DataFrame) -> DataFrame:
    """Where the readings of series of more than ``CHUNK`` go: series, bucket, home chunk and chunks that see it.

    Written, so that the plan that joins it knows its size: about one row per ``BUCKET_STEPS`` readings of hot series.
    """
    named = hot.select(*[F.col(c).alias(f"__{c}") for c in _SERIES])
    counts = readings.join(named, [F.col(c) == F.col(f"__{c}") for c in _SERIES]).groupBy(*_SERIES, _bucket().alias("bucket")).agg(F.count("*").alias("c"))
    counts = counts.withColumn("over", F.expr(f"floor(bucket / {SUPER}D)"))
    upper = counts.groupBy(*_SERIES, "over").agg(F.sum("c").alias("oc"), F.max("c").alias("om"))
    earlier = Window.partitionBy(*_SERIES).orderBy("over").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_SERIES)
    upper = upper.select(*_SERIES, "over", F.coalesce(F.sum("oc").over(earlier), F.lit(0)).alias("base"), F.max("om").over(whole).alias("most"))
    inside = Window.partitionBy(*_SERIES, "over").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(upper, [*_SERIES, "over"]).withColumn("a", F.col("base") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    lo = F.floor(F.greatest(F.col("a") - HALO - F.col("most"), F.lit(0)) / CHUNK)
    hi = F.floor((F.col("a") + F.col("c") - 1 + HALO) / CHUNK)
    names = [F.col(c).alias(f"__{c}") for c in (*_SERIES, "bucket")]
    return written(placed.select(*names, F.floor(F.col("a") / CHUNK).alias("home"), F.sequence(lo, hi).alias("seen")), "hot-buckets")


def _bucket() -> Column:
    return F.expr(f"floor(us / ({BUCKET_STEPS} * coalesce(if(step_s > 0, step_s, null), {FALLBACK_STEP_S}) * 1000000D))")


def _chunks(readings: DataFrame, hot: DataFrame) -> DataFrame:
    """Readings with chunk, own and hot; those near a chunk's edge appear in the next chunk too."""
    columns = [*_SERIES, "us", "o", "first_id", "last_id", "n_rows"]
    if hot.isEmpty():
        return readings.select(*columns, F.lit(0).cast("long").alias("chunk"), F.lit(False).alias("hot"), F.lit(True).alias("own"))
    keys = [F.col(c) == F.col(f"__{c}") for c in (*_SERIES, "bucket")]
    j = readings.withColumn("bucket", _bucket()).join(_hot_buckets(readings, hot), keys, "left")
    out = j.withColumn("chunk", F.explode(F.coalesce("seen", F.array(F.lit(0).cast("long")))))
    return out.select(*columns, "chunk", F.col("home").isNotNull().alias("hot"), (F.coalesce("home", F.lit(0)) == F.col("chunk")).alias("own"))


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, below, c, v, s1, s2 = (b[k].to_numpy(zero_copy_only=False) for k in ("n", "below", "c", "v", "upto_r", "upto_rr"))
        yield pa.RecordBatch.from_arrays([*[b[k] for k in _SERIES], pa.array(_extreme(n, below, c, v, s1, s2)), b["v"]], names=[*_SERIES, "rank", "v"])


def _hot_spikes(pending: DataFrame) -> DataFrame:
    """The spikes of chunked series, from all their readings, by the same decomposition, limits and check as whole ones."""
    size = pending.groupBy(*_SERIES).agg(F.count("*").alias("n_all"), (F.max("us") - F.min("us")).alias("span"))
    moving = pending.where(F.col("kind") == "pending")
    scatter = exact_medians(moving.withColumn("away", F.abs("d")), _SERIES, "away", "m_away").drop("n")
    hour = F.expr(f"pmod(us, {DAY_US}) * {BINS} div {DAY_US}")
    cycle = exact_medians(pending.withColumn("cell", hour), [*_SERIES, "cell"], "d", "m_cycle").where(F.col("n") > HOUR_LEAST).drop("n")
    long = size.where((F.col("span") >= CYCLE_US) & (F.col("n_all") > CYCLE_LEAST)).select(*_SERIES)
    cycle = cycle.join(long, _SERIES, "left_semi")
    x = moving.withColumn("cell", hour).join(cycle, [*_SERIES, "cell"], "left").withColumn("r", F.col("d") - F.coalesce("m_cycle", F.lit(0.0)))
    x = written(x.select(*_SERIES, "us", "first_id", "last_id", "n_rows", "dev", "r", F.abs("r").alias("v")), "remainders")
    sorted_ = ranked(x.withColumn("rr", F.col("r") * F.col("r")), _SERIES, "v", ("r", "rr"))
    upper = sorted_.where(F.col("n") - F.col("below") - F.col("c") < F.floor(F.col("n") / TESTED))
    tested = map_arrow(upper.select(*_SERIES, "n", "below", "c", "v", "upto_r", "upto_rr"), _beyond, "case_id string, L double, hand string, rank long, v double")
    # Smaller remainders have larger ranks: all down to the last one beyond its limit are candidates.
    least = tested.where("rank > 0").groupBy(*_SERIES).agg(F.min("v").alias("least"))
    j = x.join(least, _SERIES).join(scatter, _SERIES).join(size.where(F.col("n_all") >= SERIES_LEAST), _SERIES)
    return j.where((F.col("v") >= F.col("least")) & (F.col("dev") > SCATTERS * MAD * F.col("m_away")))


def implausible_readings(samples: DataFrame, cases: DataFrame, domains: DataFrame) -> DataFrame:
    """sample_id and kind (impossible, stuck, spike) of the readings an instrument cannot truly have seen.

    Rows with a null or NaN among case_id, t, L, hand, O, or a hand other than exactly L or R, aren't judged. Readings of
    a case or domain that isn't listed have no possible range; only infinite ones are impossible. Re-sent rows (same
    case_id, t, L, hand) are one reading, which has the O of its lowest sample_id. Other input columns are left out.
    """
    rows = _eligible(samples, cases, domains)
    impossible = rows.where("impossible").select("sample_id", F.lit("impossible").alias("kind"))
    fair = rows.where(~F.col("impossible"))
    first = F.coalesce("sample_id", F.lit(2**63 - 1))
    readings = fair.groupBy(*_SERIES, "us").agg(F.min_by("o", first).alias("o"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"), F.count("*").alias("n_rows"), F.min("step_s").alias("step_s"))
    readings = written(readings, "readings")
    sizes = written(readings.groupBy(*_SERIES).agg(F.count("*").alias("n"), F.max("n_rows").alias("copies")), "series")
    total, copies = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    parts = kernel_partitions(samples.sparkSession, total)
    hot = sizes.where(F.col("n") > CHUNK)
    cut = _chunks(readings, hot).repartition(parts, *_SERIES, "chunk").sortWithinPartitions(*_SERIES, "chunk", "us")
    # Written once, so that the judgement isn't made again for each use below.
    judged = written(map_arrow(cut, _judge_batches, _OUT), "judged")
    columns = [*_SERIES, "us", "first_id", "last_id", "n_rows"]
    flagged = judged.where(F.col("kind").isin("stuck", "spike")).select(*columns, "kind")
    if not hot.isEmpty():
        pending = judged.where(F.col("kind").startswith("pending"))
        flagged = flagged.unionByName(pending.where(F.col("kind") == "pending stuck").select(*columns, F.lit("stuck").alias("kind")))
        flagged = flagged.unionByName(_hot_spikes(pending).select(*columns, F.lit("spike").alias("kind")))
    ids = F.when(F.col("n_rows") == 1, F.array("first_id")).otherwise(F.array("first_id", "last_id"))
    out = impossible.unionByName(flagged.where("n_rows <= 2").select(F.explode(ids).alias("sample_id"), "kind"))
    if copies > 2:
        many = flagged.where("n_rows > 2").select(*[F.col(c).alias(f"__{c}") for c in (*_SERIES, "us")], "kind")
        keys = [F.col(c) == F.col(f"__{c}") for c in (*_SERIES, "us")]
        out = out.unionByName(fair.join(many, keys).select("sample_id", "kind"))
    return out
