"""Welch spectra over the reference's segments."""

import math

import numpy as np
import pytest

from conftest import SMALL

import __spark_entry__ as entry
from enanto.operators import curve, knees


def on_grid(spark, series):
    return spark.createDataFrame([(c, 60 * int(i), 60, float(v)) for c, points in series.items() for i, v in points], "case_id string, slot_s bigint, step_s bigint, value double")


def direct(pieces, n):
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segs = [v[s : s + n] for v in pieces for s in range(0, len(v) - n + 1, n - n // 2)]
    p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2 for s in segs], axis=0) / (w * w).sum()
    p[1 : (n + 1) // 2] *= 2
    return p, len(segs)


@pytest.mark.parametrize("block", [512, 4096])
def test_segments_follow_unbroken_stretches(spark, monkeypatch, block):
    monkeypatch.setattr(knees, "STRETCH_BLOCK", block)
    rng = np.random.default_rng(4)
    lengths = {"long": [1400, 300, 100], "odd": [201, 90, 5], "short": [7, 6], "none": [700]}
    starts, pieces, series = {"long": -333, "odd": 50, "short": 0, "none": 4096 - 350}, {}, {}
    for c, sizes in lengths.items():
        at, pieces[c], series[c] = starts[c], [], []
        for n in sizes:
            v = rng.normal(0, 1, n) + np.sin(2 * np.pi * np.arange(n) / 40)
            pieces[c].append(v)
            series[c] += [(at + i, x) for i, x in enumerate(v)]
            at += n + 3
    got = {}
    for r in knees.welch(on_grid(spark, series)).collect():
        got.setdefault(r.case_id, {})[round(r.freq * r.segment)] = r
    assert set(got) == {"long", "odd", "none"}
    for c, n in {"long": 256, "odd": 201, "none": 256}.items():
        p, count = direct(pieces[c], n)
        assert {r.segment for r in got[c].values()} == {n} and {r.n_segments for r in got[c].values()} == {count}
        assert np.allclose([got[c][f].power for f in range(len(p))], p)


def test_long_periods_show(spark):
    i = np.arange(1024)
    g = on_grid(spark, {"a": list(zip(i, np.sin(2 * np.pi * i / 64)))})
    t = knees.ticks(knees.welch(g)).first()
    assert t.band_lo < 2 * math.pi / 64 < t.band_hi
    few = knees.ticks(knees.spectra(g, 16)).first()
    assert not few.band_lo < 2 * math.pi / 64 < few.band_hi


def test_halved_segments_and_knees_below_a_32nd(spark):
    f = np.arange(1, 65) / 128.0
    p = spark.createDataFrame([("a", float(x), float(x**-3.0 if x > 4 / 128 else (4 / 128) ** -3.0), 1) for x in f], "case_id string, L double, eta double, n bigint")
    k = curve.knee_candidates(curve.log_points(p, "case_id"), "case_id", apart=3).collect()
    best = max(k, key=lambda r: r.delta_bic)
    assert best.L_k == pytest.approx(4 / 128) and {r.k for r in k} == set(range(3, 61))
    g = on_grid(spark, {"a": [(i, float(i % 7)) for i in range(100)], "b": [(i, float(i % 7)) for i in range(23)], "c": [(i, float(i % 7)) for i in range(24)]})
    s = {r.case_id: r.segment for r in knees.welch(g, 128, 24, 16).select("case_id", "segment").distinct().collect()}
    assert s == {"a": 50, "c": 16}


@pytest.mark.parametrize("name", ["spectra_full", "ticks_full", "spectral_knees_full"])
def test_registered(spark, name):
    got = entry.queries()[name](spark, SMALL).collect()
    assert len(got) == len(set(got))
    if name == "spectra_full":
        assert got and all(8 <= r.segment <= 256 for r in got)
