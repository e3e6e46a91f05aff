import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from enanto.functions import aggregates, scalars
from enanto.operators import curve, diagnostics, evaluation, generate, knees, pairing, resampling, spatial

T0 = dt.datetime(2001, 1, 1)
NAN = float("nan")
SAMPLES = "sample_id bigint, load_id bigint, case_id string, t timestamp_ntz, L double, hand string, O double, eta string"


def samples(spark, data):
    return spark.createDataFrame([(i, 1, *r, "clash") for i, r in enumerate(data, 1)], SAMPLES)


def curve_points(spark, curves):
    data = [(s, float(L), float(e), 10) for s, (Ls, es) in curves.items() for L, e in zip(Ls, es)]
    return curve.log_points(spark.createDataFrame(data, "s string, L double, eta double, n bigint"), "s")


def test_pairs(spark):
    s = samples(spark, [("a", T0, 10.0, "L", 1.0), ("a", T0, 10.0, "R", 0.8), ("a", T0, 10.0, "R", 5.0), ("a", T0, 20.0, "L", 1.0), (None, T0, 10.0, "L", 1.0), ("b", T0, NAN, "L", 1.0), ("b", T0, 1.0, "l", 1.0), ("b", None, 1.0, "R", 1.0), ("b", T0, 1.0, "R", None)])
    p = pairing.pair_table(s).collect()
    assert len(p) == 1 and p[0].eta == pytest.approx(0.2 / 0.9) and p[0].signed_parity > 0
    assert [(r.case_id, r.L, r.missing_hand) for r in pairing.unpaired(s).collect()] == [("a", 20.0, "R")]
    assert [(r.hand, r.n_rows) for r in pairing.duplicate_keys(s).collect()] == [("R", 2)]
    assert rows(pairing.completeness(s)) == [("a", 2, 1, 0.5)]
    for f in (pairing.pair_table, pairing.unpaired, pairing.completeness):
        assert f(s.limit(0)).count() == 0


def test_bounded_median(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 1000, 4001):
        v = rng.normal(0, 1, n)
        got = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double").agg(aggregates.median(F.col("x")).alias("m")).first().m
        assert got == pytest.approx(np.median(v), abs=1e-15)
    assert spark.createDataFrame([(None,)], "x double").agg(aggregates.median(F.col("x")).alias("m")).first().m is None


def test_fits_against_least_squares(spark):
    rng = np.random.default_rng(3)
    L = np.geomspace(8, 230, 14)
    eta = 0.02 * L**0.8 * np.exp(rng.normal(0, 0.1, 14))
    p = curve_points(spark, {"a": (L, eta), "one": ([5.0], [0.1]), "none": ([-1.0, 0.0], [0.1, 0.2])})
    x, y = np.log(L), np.log(eta)
    line = {r.s: r for r in curve.line_fits(p, "s").collect()}
    assert set(line) == {"a"} and line["a"].slope == pytest.approx(np.polyfit(x, y, 1)[0])
    for r in curve.hinge_fits(p, "s").collect():
        d = x - x[r.k]
        X = np.column_stack([np.ones_like(x), np.minimum(d, 0), np.maximum(d, 0)])
        beta, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
        assert (r.slope_left, r.slope_right, r.rss) == pytest.approx((beta[1], beta[2], rss[0]), rel=1e-6)
    pairs = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(14) for j in range(i + 1, 14)]
    assert curve.theil_sen(p, "s").first().slope == pytest.approx(np.median(pairs))
    g = curve.curvature(p.where("s = 'a'"), "s").orderBy("i").collect()
    d1 = np.gradient(y, x)
    assert np.allclose([r.d1 for r in g], d1) and np.allclose([r.kappa for r in g], np.abs(np.gradient(d1, x)) / (1 + d1**2) ** 1.5)
    w = curve.weighted_lines(p, "s").first()
    assert 0.5 < w.gamma < 1.1 and w.Delta_hat == pytest.approx(2 - w.gamma)


def test_knee_kernel():
    L = np.geomspace(8, 230, 14)
    bend = np.where(L < 40, 0.01 * L**1.5, 0.01 * 40**1.5 * (L / 40) ** -1.0)
    for method in knees.METHODS:
        k = knees.knee(L, bend, 1, {"edge_buffer_frac": 0.05, "method": method})
        assert 25 < k["band_lo"] < k["band_hi"] < 90 or k["band_found"]
        if method == "segmented":
            assert k["has_knee"] and 25 < k["L_k"] < 60 and k["knee_lo"] <= k["knee_hi"] and 0 < k["confidence"] <= 1 and k["slope_left"] > 1 > 0 > k["slope_right"]
    assert knees.knee(L, bend, 1, {"edge_buffer_frac": 0.05, "curvature_alignment_min": 1.01})["reasons"] == "no_candidate"
    with pytest.raises(ValueError):
        knees.knee(L, bend, 1, {"method": "other"})
    rng = np.random.default_rng(0)
    flat = knees.knee(np.geomspace(5, 300, 18), 0.01 * np.geomspace(5, 300, 18) ** 1.2 * np.exp(rng.normal(0, 0.02, 18)), 1)
    assert not flat["has_knee"] and flat["confidence"] == 0.0 and 0 <= flat["knee_p"] <= 1
    for bad in (([], []), ([1.0], [1.0]), ([1.0, 2.0, 3.0], [1.0, 1.0, 1.0]), ([2.0] * 12, [1.0] * 12)):
        assert not knees.knee(np.array(bad[0]), np.array(bad[1]), 1)["has_knee"]


def test_candidates_against_plain_fits():
    rng = np.random.default_rng(7)
    x, ks = np.sort(rng.uniform(1, 5, (6, 16)), axis=1), np.arange(3, 12)
    x[5, 4] = x[5, 3]  # a repeated size
    y = np.where(x < 3, x, 6 - x) + rng.normal(0, 0.1, x.shape)
    c = knees._candidates(x, y, np.exp(x), ks, knees.KNEE)
    for r in range(6):
        rss = []
        for j, k in enumerate(ks):
            d = x[r] - x[r, k]
            X = np.column_stack([np.ones(16), np.minimum(d, 0), np.maximum(d, 0)])
            beta, res = np.linalg.lstsq(X, y[r], rcond=None)[:2]
            rss.append(res[0])
            assert (c["left"][r, j], c["right"][r, j]) == pytest.approx((beta[1], beta[2]), rel=1e-6)
        g = np.arange(16.0) if r == 5 else x[r]
        d1 = np.gradient(y[r], g)
        bent = int(np.argmax(np.abs(np.gradient(d1, g)) / (1 + d1**2) ** 1.5))
        gaps = [abs(y[r, k:].mean() - y[r, :k].mean()) for k in range(1, 15)]
        want = set(ks[np.argsort(rss)[:6]]) | {k for k in (bent, int(np.argmax(gaps)) + 1) if k in ks}
        assert set(ks[c["on"][r]]) == want
        z = 0
        for v in (c["gain"], c["bend"], c["calm"]):
            w = v[r][c["on"][r]]
            med = np.median(w)
            z = z + (w - med) / (1.4826 * np.median(np.abs(w - med)))
        assert np.allclose(c["strength"][r][c["on"][r]], z)


def test_unstable_band_and_scalings(spark):
    rng = np.random.default_rng(8)
    L = np.geomspace(5, 300, 30)
    y = 1.3 * np.log(L) + rng.normal(0, 0.005, 30)
    y[13:17] += rng.normal(0, 1.0, 4)
    lo, hi = knees.unstable_band(L, np.log(L), y)
    assert L[9] <= lo < hi <= L[20] and knees.unstable_band(L[:5], np.log(L[:5]), y[:5]) is None
    p = spark.createDataFrame([("a", i, float(v), float(w), 1.0, float(lo), float(hi)) for i, (v, w) in enumerate(zip(L, y))] + [("b", i, float(v), 0.5 * math.log(v), 1.0, None, None) for i, v in enumerate(L)] + [("c", i, float(v), 0.1, 1.0, None, None) for i, v in enumerate(L[:3])], "s string, i int, L double, y double, weight double, band_lo double, band_hi double")
    for method, robust in (("wls", True), ("wls", False), ("theil_sen", True)):
        g = {r.s: r for r in knees.scalings(p, "s", method, robust, n=200).collect()}
        assert set(g) == {"a", "b"} and g["a"].n_points == sum((v < lo) | (v > hi) for v in L)
        assert g["a"].ci_lo - 1e-9 <= g["a"].gamma <= g["a"].ci_hi + 1e-9 and abs(g["a"].gamma - 1.3) < 0.1 and g["b"].gamma == pytest.approx(0.5) and g["b"].Delta_hat == pytest.approx(1.5)
    with pytest.raises(ValueError):
        knees.scalings(p, "s", "ols")


def test_huber_resists_outliers():
    x = np.linspace(0, 5, 30)
    y = 1.7 * x + 0.2
    y[5] += 40
    m, b = knees.huber_line(x, y)
    assert m == pytest.approx(1.7, abs=0.01) and b == pytest.approx(0.2, abs=0.02)
    with pytest.raises(ValueError):
        knees.huber_line(x, y, np.zeros(30))


def test_diagnosis_does_not_depend_on_partitioning(spark):
    L = np.geomspace(8, 230, 14)
    curves = {f"s{i}": (L, np.where(L < 40, 0.01 * L**1.4, 0.01 * 40**1.4) * np.exp(np.random.default_rng(i).normal(0, 0.03, 14))) for i in range(6)}
    p = curve_points(spark, curves)
    a, b = (rows(knees.diagnose(p.repartition(n), "s")) for n in (1, 7))
    assert a == b and len(a) == 6


def test_spectrum_matches_direct_transform(spark):
    rng = np.random.default_rng(2)
    v = np.sin(2 * np.pi * np.arange(80) * 5 / 16) + rng.normal(0, 0.1, 80)
    g = spark.createDataFrame([("a", 60 * i, 60, float(x)) for i, x in enumerate(v)], "case_id string, slot_s bigint, step_s bigint, value double")
    got = {round(r.freq * 16): r.power for r in knees.spectra(g, 16).collect()}
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    segs = [v[s : s + 16] for s in range(0, 80 - 15, 8)]
    power = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2 for s in segs], axis=0) / (w * w).sum()
    power[1:-1] *= 2
    assert np.allclose([got[k] for k in range(9)], power)
    t = knees.ticks(knees.spectra(g, 16)).first()
    assert t.band_lo < 2 * math.pi * 5 / 16 < t.band_hi
    assert knees.spectra(g.limit(10), 16).count() == 0


def test_phase_scramble_keeps_spectrum(spark):
    L = np.geomspace(8, 230, 15)
    p = curve_points(spark, {"a": (L, 0.01 * L)})
    r = sorted(knees.phase_scrambled(p, "s").collect(), key=lambda r: r.i)
    a, b = (np.abs(np.fft.rfft([x[c] for x in r])) for c in ("y", "y_scrambled"))
    assert np.allclose(a, b)


def test_expressions(spark):
    d = spark.createDataFrame([(1.0,), (0.02,), (-0.3,), (None,)], "g double").select(*[c.alias(n) for n, c in diagnostics.stability(F.col("g")).items()])
    assert [r.class_hat for r in d.collect()] == ["stable", "marginal", "forbidden", None]
    z = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double").select(scalars.round_half_even(F.col("x"), 1.0).alias("r"), scalars.floor_to(F.col("x"), 2.0).alias("f"), scalars.safe_log(F.col("x")).alias("l")).collect()
    assert [r.r for r in z] == [0.0, 2.0, 2.0, 0.0] and [r.f for r in z] == [0.0, 0.0, 2.0, -2.0] and z[3].l == pytest.approx(math.log(1e-12))
    t = spark.createDataFrame([(" TRUE ",), ("yes",), ("0",), (None,)], "x string").select(scalars.truthy(F.col("x")).alias("b"))
    assert [r.b for r in t.collect()] == [True, True, False, False]
    a = spark.range(1).select(generate.axis(1.0, 100.0, 3, "log").alias("a"), generate.axis(0.0, 1.0, 3).alias("b")).first()
    assert np.allclose(a.a, [1, 10, 100]) and a.b == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        generate.axis(0.0, 1.0, 3, "log")


def test_permutation_keeps_values(spark):
    d = spark.createDataFrame([("g" if i % 3 else None, f"{i:04}", float(i % 50)) for i in range(400)], "g string, k string, v double")
    s = resampling.shuffled(d, ["g"], "v", "k").collect()
    for g in ("g", None):
        assert sorted(r.v for r in s if r.g == g) == sorted(float(i % 50) for i in range(400) if (i % 3 > 0) == (g == "g"))
    assert sum(r.v != float(int(r.k) % 50) for r in s) > 300


def test_folds_are_even(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(2000)], "id bigint, c string")
    n = evaluation.stratified_folds(d, "c", "id", 5).groupBy("c", "fold").count().collect()
    assert len(n) == 10 and all(150 < r["count"] < 250 for r in n)


def test_controls_are_used_once(spark):
    c = spark.createDataFrame([(f"e{i}", "d", 60, "storm", 10.0, 10.0) for i in range(5)] + [(f"c{i}", "d", 60, "control", 10.0 if i < 2 else 70.0, 10.0) for i in range(4)], "case_id string, domain string, step_s int, case_type string, lat0 double, lon0 double")
    m = spatial.matched_controls(c).collect()
    assert len(m) == 4 == len({r.control_id for r in m}) == len({r.case_id for r in m})
    assert sorted(r.control_tier for r in m) == ["A", "A", "C", "C"]
