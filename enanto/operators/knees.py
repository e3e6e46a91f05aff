"""Knee detection with a bootstrap posterior, robust scaling and spectra: numerical kernels over bounded groups.

A group is one series of some tens of sizes; Spark partitions the series. Readings never reach these kernels, only the
curves that were aggregated from them. Draws are seeded by the series' key, so results don't depend on partitioning.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resampling import per_series
from ..session import kernel_partitions, map_arrow

# Defaults that change results.
KNEE = {
    "method": "segmented",
    "max_candidates": 6,
    "bic_delta_min": 10.0,
    "knee_strength_min": 0.5,
    "knee_p_min": 0.35,
    "bootstrap_n": 200,
    "bootstrap_cov_max": 0.25,
    "edge_buffer_frac": 0.15,
    "min_side": 3,
    "min_frac": 0.2,
    "slope_abs_max": 6.0,
    "post_slope_max": 6.0,
    "resid_improvement_min": 0.0,
    "curvature_peak_ratio_min": 0.0,
    "curvature_alignment_min": 0.0,
    "instability_window": 7,
    "instability_zscore": 2.0,
    "middle_max": 0.6,
    "rho": 1.5,
}
METHODS = ("segmented", "log_curvature", "cpt")
_KNEE_SCHEMA = (
    "has_knee boolean, L_k double, knee_p double, knee_lo double, knee_hi double, delta_bic double, strength double, delta_gamma double, confidence double, reasons string, "
    "slope_left double, slope_right double, resid_improvement double, curvature_peak_ratio double, curvature_alignment double, middle_score double, "
    "cov double, n_samples int, post_slope_std double, band_lo double, band_hi double, band_found boolean"
)
_KNEE_FIELDS = [f.split()[0] for f in _KNEE_SCHEMA.split(", ")]
HUBER_DELTA = 1.5
TINY = 1e-12


def _nan_median(v: np.ndarray) -> np.ndarray:
    """Median along the last axis without NaN, which sort last."""
    s = np.sort(v, axis=-1)
    n = np.maximum((~np.isnan(v)).sum(axis=-1, keepdims=True), 1)
    return (np.take_along_axis(s, (n - 1) // 2, -1) + np.take_along_axis(s, n // 2, -1)) / 2


def _robust_z(v: np.ndarray) -> np.ndarray:
    """Along the last axis, NaN left out: by median and MAD, else mean and deviation, else 0."""
    med = _nan_median(v)
    mad = 1.4826 * _nan_median(np.abs(v - med))
    n = np.maximum((~np.isnan(v)).sum(axis=-1, keepdims=True), 1)
    mean = np.nansum(v, axis=-1, keepdims=True) / n
    sd = np.sqrt(np.nansum((v - mean) ** 2, axis=-1, keepdims=True) / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(mad > TINY, (v - med) / mad, np.where(sd > TINY, (v - mean) / sd, 0.0))


def _lag1(r: np.ndarray) -> np.ndarray:
    a, b = r[..., :-1], r[..., 1:]
    n = a.shape[-1]
    sa, sb = a.sum(-1), b.sum(-1)
    dot = lambda p, q: np.einsum("...n,...n->...", p, q)
    va, vb = dot(a, a) - sa * sa / n, dot(b, b) - sb * sb / n
    d = np.sqrt(np.maximum(va, 0.0) * np.maximum(vb, 0.0))
    return np.where(d > TINY, (dot(a, b) - sa * sb / n) / np.maximum(d, TINY), 0.0)


def _bic(rss: np.ndarray, n: int, k: int) -> np.ndarray:
    return n * np.log(np.maximum(rss, TINY) / n) + k * math.log(max(n, 2))


def _gradient(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Derivative along rows: second order inside on uneven steps, first order at the ends."""
    h = np.diff(x, axis=-1)
    slope = np.diff(y, axis=-1) / h
    out = np.empty_like(y)
    out[..., 0], out[..., -1] = slope[..., 0], slope[..., -1]
    a, b = h[..., :-1], h[..., 1:]
    out[..., 1:-1] = (slope[..., :-1] * b + slope[..., 1:] * a) / (a + b)
    return out


def curvature(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|y''| / (1 + y'^2)^1.5 of each row, over its places where x repeats; NaN where that isn't finite."""
    place = np.broadcast_to(np.arange(x.shape[-1], dtype=float), x.shape)
    grid = np.where((np.diff(x, axis=-1) == 0).any(axis=-1, keepdims=True), place, x)
    y1 = _gradient(y, grid)
    c = np.abs(_gradient(y1, grid)) / (1.0 + y1 * y1) ** 1.5
    return np.where(np.isfinite(c), c, np.nan)


def _largest_shift(y: np.ndarray) -> np.ndarray:
    """Place of each row's largest difference between the means before it and from it on."""
    n = y.shape[-1]
    k = np.arange(1, n - 1)
    upto = np.cumsum(y, axis=-1)[..., :-2]
    gap = np.abs((y.sum(-1, keepdims=True) - upto) / (n - k) - upto / k) / (y.std(-1, keepdims=True) + TINY)
    return gap.argmax(-1) + 1


def proposed(rss: np.ndarray, curv: np.ndarray, y: np.ndarray, ks: np.ndarray, method: str, most: int) -> np.ndarray:
    """Which breaks ks of each row are looked at: those the method proposes, the most curved and the largest shift.

    ``segmented`` proposes the ``most`` best joined lines, ``log_curvature`` and ``cpt`` one place each.
    """
    n = y.shape[-1]
    empty = np.isnan(curv).all(axis=-1)
    bent = np.where(empty, max(1, min(n - 2, n // 2)), np.where(np.isnan(curv), -np.inf, curv).argmax(-1))
    out = (ks == bent[:, None]) | (ks == _largest_shift(y)[:, None])
    if method == "segmented":
        out |= np.argsort(np.argsort(rss, axis=-1, kind="stable"), axis=-1, kind="stable") < most
    elif method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method}")
    return out


def _candidates(x: np.ndarray, y: np.ndarray, L: np.ndarray, ks: np.ndarray, o: dict) -> dict[str, np.ndarray]:
    """Joined-line fits at the proposed breaks of each row of resamples x, y, L (rows sorted by L); others are not ``on``."""
    n = x.shape[-1]
    xc, yc = x - x.mean(-1, keepdims=True), y - y.mean(-1, keepdims=True)
    sxx = (xc * xc).sum(-1)
    b = np.where(sxx > TINY, (xc * yc).sum(-1) / np.maximum(sxx, TINY), 0.0)
    r0 = yc - b[..., None] * xc
    bic0, ac0 = _bic((r0 * r0).sum(-1), n, 2), _lag1(r0)
    # Moments of both sides of every break from running sums.
    xk = xc[:, ks]
    nl, nr = ks + 1.0, n - ks - 1.0
    sx, sxx_, sy, sxy = (np.cumsum(q, axis=-1) for q in (xc, xc * xc, yc, xc * yc))
    lx, lxx, ly, lxy = (q[:, ks] for q in (sx, sxx_, sy, sxy))
    rx, rxx, ry, rxy = (q[:, -1:] - q[:, ks] for q in (sx, sxx_, sy, sxy))
    su, sv = lx - nl * xk, rx - nr * xk
    uu, vv, uv = lxx - 2 * xk * lx + nl * xk * xk - su * su / n, rxx - 2 * xk * rx + nr * xk * xk - sv * sv / n, -su * sv / n
    uy, vy = lxy - xk * ly, rxy - xk * ry
    det = uu * vv - uv * uv
    good = det > 1e-10 * np.maximum(uu * vv, TINY)
    safe = np.where(good, det, 1.0)
    # Where one side has no extent its slope is 0, as the least-norm solution has it.
    left = np.where(good, (uy * vv - vy * uv) / safe, np.where(uu > 1e-10, uy / np.maximum(uu, TINY), 0.0))
    right = np.where(good, (vy * uu - uy * uv) / safe, np.where((vv > 1e-10) & (uu <= 1e-10), vy / np.maximum(vv, TINY), 0.0))
    d = xc[:, None, :] - xk[:, :, None]
    r = yc[:, None, :] - d * np.where(d < 0, left[..., None], right[..., None])
    r -= r.mean(-1, keepdims=True)
    rss = np.einsum("rkn,rkn->rk", r, r)
    bic1 = _bic(rss, n, 3)
    gain, bend, calm = bic0[:, None] - bic1, np.abs(right - left), np.abs(ac0)[:, None] - np.abs(_lag1(r))
    curv = curvature(x, y)
    on = proposed(rss, curv, y, ks, o["method"], o["max_candidates"])
    curv = np.nan_to_num(curv)
    peak = curv.max(-1)
    ratio = peak / (curv.mean(-1) + TINY)
    align = np.where(peak[:, None] > TINY, curv[:, ks] / np.maximum(peak, TINY)[:, None], 0.0)
    lk = L[:, ks]
    lo, hi = L[:, :1], L[:, -1:]
    edge = np.minimum(lk - lo, hi - lk) / np.maximum(hi - lo, TINY)
    gates = {
        "slope_unphysical": (np.abs(left) <= o["slope_abs_max"]) & (np.abs(right) <= o["slope_abs_max"]),
        "post_slope_too_flat": right <= o["post_slope_max"],
        "resid_improvement_weak": calm >= o["resid_improvement_min"],
        "curvature_peak_weak": np.broadcast_to((ratio >= o["curvature_peak_ratio_min"])[:, None], lk.shape),
        "curvature_alignment_weak": align >= o["curvature_alignment_min"],
        "knee_at_edge": edge >= o["edge_buffer_frac"],
    }
    strength = sum(_robust_z(np.where(on, v, np.nan)) for v in (gain, bend, calm))
    sane = on & np.logical_and.reduce(list(gates.values()))
    return {"on": on, "gain": gain, "bend": bend, "calm": calm, "strength": strength, "left": left, "right": right, "L": lk, "sane": sane, "gates": gates, "ratio": np.broadcast_to(ratio[:, None], lk.shape), "align": align, "bic1": bic1}


def _choose(c: dict[str, np.ndarray], gain: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Index of the strongest sane candidate over both minimums per row, and whether there is one."""
    with np.errstate(invalid="ignore"):
        ok = c["sane"] & (c["gain"] >= gain) & (c["strength"] >= strength)
    s = np.where(ok, c["strength"], -np.inf)
    return s.argmax(-1), ok.any(-1)


def _theil_sen(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Median of the slopes of all pairs with different x, and the intercept through the medians; 0 without such a pair."""
    i, j = np.triu_indices(len(x), 1)
    dx = x[j] - x[i]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (y[j] - y[i])[dx != 0] / dx[dx != 0]
    m = float(np.median(s)) if len(s) else 0.0
    return m, float(np.median(y) - m * np.median(x))


def unstable_band(L: np.ndarray, x: np.ndarray, y: np.ndarray, window: int = 7, zscore: float = 2.0) -> tuple[float, float] | None:
    """The longest run of at least two sizes where both the variance of nearby local slopes and the local residuals stand out.

    Local lines are medians of pairwise slopes over ``window`` sizes; outstanding is ``zscore`` robust deviations over the median.
    """
    n = len(L)
    w = max(5, window)
    w = min(w + (w % 2 == 0), n if n % 2 else n - 1)
    if n < 6 or w < 5:
        return None
    spans = [(max(0, i - w // 2), min(n, i + w // 2 + 1)) for i in range(n)]
    slope, rough = np.full(n, np.nan), np.full(n, np.nan)
    for i, (a, b) in enumerate(spans):
        if b - a >= 4:
            m, c = _theil_sen(x[a:b], y[a:b])
            slope[i], rough[i] = m, math.sqrt(np.mean((y[a:b] - m * x[a:b] - c) ** 2))
    spread = np.full(n, np.nan)
    for i, (a, b) in enumerate(spans):
        v = slope[a:b][~np.isnan(slope[a:b])]
        if len(v) >= 2:
            spread[i] = v.var()

    def out(v: np.ndarray) -> np.ndarray:
        med = np.nanmedian(v)
        return v > med + zscore * max(1.4826 * np.nanmedian(np.abs(v - med)), TINY)

    with np.errstate(invalid="ignore"):
        mask = np.concatenate(([False], out(spread) & out(rough), [False]))
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    runs = list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))
    a, b = max(runs, key=lambda r: r[1] - r[0], default=(0, 0))
    return (float(L[a]), float(L[b])) if b > a else None


def knee(L: np.ndarray, eta: np.ndarray, seed: int, options: dict | None = None) -> dict:
    """Knee of one curve: posterior probability, interval, gates with reasons, confidence, unstable band.

    Too few sizes for a break on either side give ``too_few_sizes``; where no candidate passes all gates, the reason is
    ``no_candidate``.
    """
    o = KNEE | (options or {})
    order = np.argsort(L, kind="stable")
    L, eta = np.asarray(L, float)[order], np.asarray(eta, float)[order]
    n = len(L)
    least = max(o["min_side"], math.ceil(o["min_frac"] * n))
    ks = np.arange(max(least - 1, 1), min(n - least, n - 1))
    out = {c: None for c in _KNEE_FIELDS} | {"has_knee": False, "knee_p": 0.0, "delta_bic": 0.0, "strength": 0.0, "confidence": 0.0, "reasons": "too_few_sizes", "n_samples": 0, "band_found": False}
    if n < 4:
        return out
    x, y = np.log(np.maximum(L, TINY)), np.log(np.maximum(np.abs(eta), TINY))
    band = unstable_band(L, x, y, o["instability_window"], o["instability_zscore"])
    if band:
        out |= {"band_lo": band[0], "band_hi": band[1], "band_found": True}
    if not len(ks):
        return out
    c = _candidates(x[None], y[None], L[None], ks, o)
    k, found = _choose(c, o["bic_delta_min"], o["knee_strength_min"])
    rng = np.random.default_rng(seed)
    idx = np.sort(rng.integers(0, n, (o["bootstrap_n"], n)), axis=1)
    idx = idx[(np.diff(idx, axis=1) != 0).sum(axis=1) + 1 >= max(4, o["min_side"] + 1)]
    samples = after = np.zeros(0)
    valid = 0
    if len(idx):
        b = _candidates(x[idx], y[idx], L[idx], ks, o)
        bk, hit = _choose(b, max(0.0, 0.5 * o["bic_delta_min"]), max(-0.5, 0.5 * o["knee_strength_min"]))
        valid = int(b["on"].any(-1).sum())
        samples, after = (b[f][np.arange(len(idx)), bk][hit] for f in ("L", "right"))
    p = float(len(samples) / valid) if valid else 0.0
    lo, hi = (float(np.quantile(samples, q)) for q in (0.1, 0.9)) if len(samples) else (None, None)
    cov = float(samples.std() / abs(np.median(samples))) if len(samples) >= 2 and abs(np.median(samples)) > TINY else None
    out |= {"knee_p": p, "knee_lo": lo, "knee_hi": hi, "cov": cov, "n_samples": len(samples), "post_slope_std": float(after.std()) if len(after) >= 2 else None, "reasons": "no_candidate"}
    if not found[0]:
        return out
    at = int(k[0])
    gain, strength, bend = (float(c[f][0, at]) for f in ("gain", "strength", "bend"))
    med = float(np.median(samples)) if len(samples) else float(c["L"][0, at])
    width = 0.0 if lo is None else min(1.0, (hi - lo) / max(L[-1] - L[0], TINY))
    middle = min(1.0, 0.40 * (1 - abs(2 * p - 1)) + 0.30 * width + 0.20 / (1 + math.exp(max(strength, -6.0))) + 0.10 * min(1.0, bend / 0.35))
    why = []
    if p < o["knee_p_min"]:
        why.append("knee_p_low")
    if cov is not None and cov > o["bootstrap_cov_max"] and p < 0.8:
        why.append("bootstrap_unstable")
    if middle >= o["middle_max"]:
        why.append("forbidden_middle")
    score = 0.40 * p + 0.25 * min(1.0, max(0.0, (gain - o["bic_delta_min"]) / max(5.0, o["bic_delta_min"]))) + 0.25 / (1 + math.exp(-(strength - o["knee_strength_min"])))
    score += 0.10 * (1.0 if cov is None else min(1.0, max(0.0, 1 - cov / o["bootstrap_cov_max"])))
    ok = not why
    if not band:
        out |= {"band_lo": med / o["rho"], "band_hi": med * o["rho"]}
    more = {"slope_left": "left", "slope_right": "right", "resid_improvement": "calm", "curvature_peak_ratio": "ratio", "curvature_alignment": "align"}
    out |= {name: float(c[f][0, at]) for name, f in more.items()}
    return out | {"has_knee": ok, "L_k": med if ok else None, "delta_bic": gain, "strength": strength, "delta_gamma": bend, "confidence": min(1.0, score) if ok else 0.0, "reasons": ";".join(why), "middle_score": middle}


def huber_line(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, delta: float = HUBER_DELTA, rounds: int = 32, tol: float = 1e-7) -> tuple[float, float]:
    """Slope and intercept by iteratively reweighted least squares; residuals beyond delta medians of |r| weigh less."""
    base = np.ones_like(x) if w is None else np.asarray(w, float)
    if np.any(base <= 0):
        raise ValueError("weights must be above 0")

    def solve(v: np.ndarray) -> tuple[float, float]:
        mx, my = np.average(x, weights=v), np.average(y, weights=v)
        sxx = (v * (x - mx) ** 2).sum()
        m = float((v * (x - mx) * (y - my)).sum() / sxx) if sxx > 0 else 0.0
        return m, float(my - m * mx)

    now = solve(base)
    for _ in range(rounds):
        r = np.abs(y - now[0] * x - now[1])
        reach = delta * max(float(np.median(r)), 1e-9)
        new = solve(base * np.minimum(1.0, reach / np.maximum(r, 1e-300)))
        moved = max(abs(new[0] - now[0]), abs(new[1] - now[1]))
        now = new
        if moved <= tol:
            break
    return now


def _seed(key) -> int:
    return zlib.crc32(str(key).encode())


def diagnose(points: DataFrame, series: str, options: dict | None = None, least: int = 4) -> DataFrame:
    """Knee and robust scaling of every series of log points (columns L, y), many series a task.

    The scaling line leaves out the sizes within L_k / rho..L_k rho, unless fewer than ``least`` sizes would stay; gamma
    is null for series of fewer than ``least`` sizes.
    """
    o = KNEE | (options or {})

    def one(key, L: np.ndarray, y: np.ndarray) -> dict:
        k = knee(L, np.exp(y), _seed(key), o)
        keep = np.ones(len(L), bool)
        if k["L_k"] is not None:
            keep = (L < k["L_k"] / o["rho"]) | (L > k["L_k"] * o["rho"])
            if keep.sum() < least:
                keep[:] = True
        gamma = icept = None
        if keep.sum() >= least:
            gamma, icept = huber_line(np.log(L[keep]), y[keep])
        return {c: [v] for c, v in (k | {"gamma": gamma, "intercept": icept, "n_fit": int(keep.sum())}).items()}

    return per_series(points, series, _KNEE_SCHEMA + ", gamma double, intercept double, n_fit int", one, ("L", "y"))


def slope_samples(x: np.ndarray, y: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Theil-Sen slope of each resample (rows of idx); NaN where x doesn't vary."""
    i, j = np.triu_indices(x.shape[-1], 1)
    out = np.empty(len(idx))
    for s in range(0, len(idx), 256):
        xb, yb = x[idx[s : s + 256]], y[idx[s : s + 256]]
        dx = xb[:, j] - xb[:, i]
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(dx != 0, (yb[:, j] - yb[:, i]) / dx, np.nan)
        out[s : s + 256] = _nan_median(g)[:, 0]
    return out


def scalings(points: DataFrame, series: str, method: str = "wls", robust: bool = True, least: int = 4, n: int = 2000, alpha: float = 0.05) -> DataFrame:
    """Scaling exponent of every series of log points (columns L, y, weight, band_lo, band_hi) with its interval.

    Sizes within the band (null: none) are left out; series with fewer than ``least`` others give no row. ``wls`` weighs
    the points and, where ``robust``, large residuals less; ``theil_sen`` is the median of pairwise slopes. The interval
    is of ``n`` resamples: of Theil-Sen slopes, or of plain least squares for ``wls`` without ``robust``. ``drift`` is the
    difference of the mean residuals of both halves, below four points their mean size.
    """
    if method not in ("wls", "theil_sen"):
        raise ValueError(f"method is wls or theil_sen, not {method}")

    def one(key, L, y, w, lo, hi) -> dict:
        keep = ~((L >= lo) & (L <= hi))
        L, y, w = L[keep], y[keep], w[keep]
        if len(L) < max(least, 3):
            return {c: [] for c in ("gamma", "Delta_hat", "ci_lo", "ci_hi", "drift", "n_points")}
        x = np.log(L)
        m, c = _theil_sen(x, y) if method == "theil_sen" else huber_line(x, y, w, rounds=32 if robust else 0)
        idx = np.random.default_rng(_seed(f"scaling:{key}")).integers(0, len(x), (n, len(x)))
        if method == "wls" and not robust:
            xc = x[idx] - x[idx].mean(axis=1, keepdims=True)
            sxx = (xc * xc).sum(axis=1)
            g = np.where(sxx > TINY, (xc * y[idx]).sum(axis=1) / np.maximum(sxx, TINY), np.nan)
        else:
            g = slope_samples(x, y, idx)
        a, b = np.nanquantile(g, [alpha / 2, 1 - alpha / 2])
        r = y - m * x - c
        half = len(r) // 2
        drift = abs(r[:half].mean() - r[half:].mean()) if len(r) >= 4 else np.abs(r).mean()
        return {"gamma": [float(m)], "Delta_hat": [float(2 - m)], "ci_lo": [float(a)], "ci_hi": [float(b)], "drift": [float(drift)], "n_points": [len(x)]}

    return per_series(points, series, "gamma double, Delta_hat double, ci_lo double, ci_hi double, drift double, n_points int", one, ("L", "y", "weight", "band_lo", "band_hi"))


def phase_scrambled(points: DataFrame, series: str) -> DataFrame:
    """y of each series with random phases and the same amplitude spectrum; the mean and the last frequency's phase stay."""

    def one(key, i: np.ndarray, y: np.ndarray) -> dict:
        f = np.fft.rfft(y)
        phase = np.random.default_rng(_seed(key)).uniform(-np.pi, np.pi, len(f))
        phase[[0, -1]] = np.angle(f)[[0, -1]]
        return {"i": i.astype(np.int64).tolist(), "y": y.tolist(), "y_scrambled": np.fft.irfft(np.abs(f) * np.exp(1j * phase), n=len(y)).tolist()}

    return per_series(points, series, "i long, y double, y_scrambled double", one, ("i", "y"))


SEGMENT = 64


def spectra(grid: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Welch power per case and frequency (cycles per step) of a regular grid (case_id, slot_s, step_s, value).

    Segments of ``segment`` steps overlap by half and start at multiples of half of it, so each slot knows its segments
    and no series is gathered in one task; incomplete segments don't count. Each is centred, windowed (periodic Hann) and
    transformed; powers are densities, doubled for all but the first and last frequency, averaged over segments.
    """
    hop = segment // 2
    index = F.expr("slot_s div step_s")
    first = F.expr(f"cast(floor((slot_s div step_s) / {hop}D) as bigint)")
    x = grid.where(F.col("value").isNotNull()).select("case_id", "value", index.alias("idx"), F.explode(F.array(first, first - 1)).alias("seg"))
    x = x.withColumn("k", (F.col("idx") - F.col("seg") * hop).cast("int"))
    s = x.groupBy("case_id", "seg").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("v"), F.avg("value").alias("m")).where(F.size("v") == segment)
    two_pi = 2.0 * math.pi
    norm = sum((0.5 - 0.5 * math.cos(two_pi * k / segment)) ** 2 for k in range(segment))
    w = F.transform("v", lambda e: (e["value"] - F.col("m")) * (0.5 - 0.5 * F.cos(e["k"] * (two_pi / segment))))
    s = s.select("case_id", "seg", w.alias("w")).select("case_id", "seg", "w", F.explode(F.sequence(F.lit(0), F.lit(hop))).alias("f"))

    def part(fn):
        return F.aggregate(F.transform("w", lambda e, k: e * fn(k * F.col("f") * (two_pi / segment))), F.lit(0.0), lambda a, e: a + e)

    s = s.select("case_id", "f", (part(F.cos) * part(F.cos) + part(F.sin) * part(F.sin)).alias("p"))
    twice = F.when(F.col("f").isin(0, hop), 1.0).otherwise(2.0)
    return s.groupBy("case_id", "f").agg(F.avg("p").alias("p"), F.count("*").alias("n_segments")).select("case_id", (F.col("f") / float(segment)).alias("freq"), (F.col("p") * twice / norm).alias("power"), "n_segments")


STRETCH_BLOCK = 4096  # steps that are looked at together


def _stretches(grid: DataFrame) -> DataFrame:
    """case_id, value, first (index of the first step of the unbroken stretch) and rel (steps since) of each slot with a value.

    Stretches are found within blocks of ``STRETCH_BLOCK`` steps; one that reaches a block from the one before takes its
    start from a window over one row per block.
    """
    index = F.expr("slot_s div step_s")
    x = grid.where(F.col("value").isNotNull()).select("case_id", "value", index.alias("idx"), F.expr(f"cast(floor((slot_s div step_s) / {STRETCH_BLOCK}D) as bigint)").alias("blk"))
    w = Window.partitionBy("case_id", "blk").orderBy("idx")
    fresh = F.coalesce(F.col("idx") != F.lag("idx").over(w) + 1, F.lit(True))
    x = x.withColumn("fresh", fresh).withColumn("own", F.max(F.when(F.col("fresh"), F.col("idx"))).over(w))
    b = x.groupBy("case_id", "blk").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.max("own").alias("last"))
    o = Window.partitionBy("case_id").orderBy("blk")
    b = b.withColumn("joined", F.coalesce(F.lag("hi").over(o) + 1 == F.col("lo"), F.lit(False)))
    # A block that is all one stretch and goes on from the one before passes on where that began.
    b = b.withColumn("anchor", F.when(~(F.col("joined") & (F.col("last") == F.col("lo"))), F.col("last")))
    b = b.withColumn("began", F.last("anchor", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.where("joined").select(F.col("case_id").alias("__c"), F.col("blk").alias("__b"), "lo", "began")
    j = x.join(b, (F.col("case_id") == F.col("__c")) & (F.col("blk") == F.col("__b")), "left")
    first = F.when(F.col("own") == F.col("lo"), F.col("began")).otherwise(F.col("own"))
    return j.select("case_id", "value", F.coalesce(first, F.col("own")).alias("first"), "idx").withColumn("rel", F.col("idx") - F.col("first")).drop("idx")


def welch(grid: DataFrame, most: int = 256, least_steps: int = 8, halved: int | None = None) -> DataFrame:
    """Welch power per case and frequency with the reference's segments: case_id, freq, power, segment, n_segments.

    A segment has ``most`` steps, or all of the case's longest unbroken stretch where that is shorter; with ``halved``
    half of that stretch, though at least ``halved`` steps. Segments overlap by half and start with each stretch; what is
    left of a stretch doesn't count. Each is centred, windowed (periodic Hann) and transformed by FFT, many per task.
    Cases without ``least_steps`` unbroken steps give no rows. Densities are doubled for all but the first frequency and,
    for even segments, the last.
    """
    x = _stretches(grid)
    longest = x.groupBy("case_id", "first").agg(F.count("*").alias("n")).groupBy(F.col("case_id").alias("__s")).agg(F.max("n").cast("int").alias("n")).where(F.col("n") >= least_steps)
    size = F.col("n") if halved is None else F.least(F.greatest(F.lit(halved), F.expr("n div 2")), F.col("n"))
    x = x.join(longest.select("__s", F.least(F.lit(most), size).cast("int").alias("segment")), F.col("case_id") == F.col("__s")).drop("__s")
    hop = F.expr("segment - segment div 2")
    span = F.expr(f"({STRETCH_BLOCK} div (segment - segment div 2)) * (segment - segment div 2)")
    x = x.withColumn("chunk", F.floor(F.col("rel") / span).cast("long"))
    also = (F.col("chunk") > 0) & (F.col("rel") - F.col("chunk") * span < F.col("segment") - hop)
    x = x.withColumn("chunk", F.explode(F.when(also, F.array("chunk", F.col("chunk") - 1)).otherwise(F.array("chunk"))))
    c = x.groupBy("case_id", "segment", "first", "chunk").agg(F.sort_array(F.collect_list(F.struct("rel", "value"))).alias("v")).select("case_id", "segment", F.col("v.value").alias("v"))  # at most STRETCH_BLOCK and half a segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict = {}
            for case, n, v in zip(b["case_id"].to_pylist(), b["segment"].to_pylist(), b["v"]):
                v = v.values.to_numpy(zero_copy_only=False)
                if len(v) < n:
                    continue
                s = np.lib.stride_tricks.sliding_window_view(v, n)[:: n - n // 2]
                w = 0.5 - 0.5 * np.cos(2.0 * math.pi * np.arange(n) / n)
                p = (np.abs(np.fft.rfft((s - s.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2).sum(axis=0) / (w * w).sum()
                p[1 : (n + 1) // 2] *= 2.0
                at = total.setdefault((case, n), [np.zeros(len(p)), 0])
                at[0] += p
                at[1] += len(s)
            rows = [(case, n, f, float(q), k) for (case, n), (p, k) in total.items() for f, q in enumerate(p)]
            yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["case_id", "segment", "f", "p", "k"])

    parts = map_arrow(c.repartition(kernel_partitions(grid.sparkSession)), run, "case_id string, segment int, f int, p double, k long")
    g = parts.groupBy("case_id", "segment", "f").agg((F.sum("p") / F.sum("k")).alias("power"), F.sum("k").alias("n_segments"))
    return g.select("case_id", (F.col("f") / F.col("segment")).alias("freq"), "power", "segment", "n_segments")


def ticks(spectrum: DataFrame, top: int = 3) -> DataFrame:
    """Per case the angular frequencies of its strongest peaks (ascending), R = peak / total, ridge = peak / median, band of 10 %."""
    s = spectrum.where("freq > 0")
    w = Window.partitionBy("case_id").orderBy(F.round("power", 12).desc(), "freq")
    r = s.withColumn("r", F.row_number().over(w))
    omega = 2.0 * math.pi * F.col("freq")
    return r.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("r") <= top, F.round(omega, 9)))).alias("omegas"),
        F.try_divide(F.max("power"), F.sum("power")).alias("R_Omega"),
        F.try_divide(F.max("power"), F.median("power")).alias("ridge_strength"),
        (0.9 * F.max(F.when(F.col("r") == 1, omega))).alias("band_lo"),
        (1.1 * F.max(F.when(F.col("r") == 1, omega))).alias("band_hi"),
    ).withColumn("omegas", F.array_join("omegas", "|"))
