"""Moments and shifts where loads hold fill values."""

import datetime as dt

import numpy as np
import pytest

from enanto.operators import profile

FILL = 9.96921e36
SAMPLES = "sample_id bigint, load_id bigint, case_id string, t timestamp_ntz, L double, hand string, O double"


def test_fill_values_leave_shifts_and_moments_alone(spark):
    rng = np.random.default_rng(6)
    clean = {load: (rng.normal(12 + 4 * (load == 2), 1, 300), rng.choice([10.0, 20.0, 40.0], 300)) for load in range(1, 6)}
    clean[9] = (rng.normal(1e5, 1, 50), np.full(50, 5.0))  # not listed
    data = [(load, float(a), float(b)) for load, (o, s) in clean.items() for a, b in zip(o, s)]
    data += [(1, FILL, 10.0), (4, FILL, 10.0), (4, -5.0, 10.0), (5, float("inf"), 10.0), (6, FILL, 10.0)]
    rows = [(i, load, "c", dt.datetime(2001, 1, 1), s, "L", o) for i, (load, o, s) in enumerate(data)]
    t = spark.createDataFrame(rows, SAMPLES)
    loads = spark.createDataFrame([(i, "d") for i in range(1, 7)], "load_id bigint, domain string")
    domains = spark.createDataFrame([("d", 0.0, 24.0)], "domain string, o_min double, o_max double")
    got = {r.load_id: r for r in profile.standardised_shifts(t, loads, domains).where("column_name = 'O'").collect()}
    for load in range(1, 6):
        own, rest = clean[load][0], np.concatenate([clean[k][0] for k in range(1, 6) if k != load])
        r = got[load]
        assert (r.n_finite, r.mean, r.mean_rest) == (300, pytest.approx(own.mean()), pytest.approx(rest.mean()))
        assert r["shift"] == pytest.approx((own.mean() - rest.mean()) / np.sqrt((own.var() + rest.var()) / 2))
    assert [got[i].n_violations for i in range(1, 7)] == [1, 0, 0, 2, 1, 1]
    assert got[6]["shift"] is None and got[9].mean_rest is None and got[9].mean == pytest.approx(clean[9][0].mean())
    p = {r.load_id: r for r in profile.column_profile(t, loads, domains).where("column_name = 'O'").collect()}
    for load in (1, 2, 4, 5, 9):
        o = clean[load][0]
        z = (o - o.mean()) / o.std()
        assert (p[load].mean, p[load]["std"]) == (pytest.approx(o.mean()), pytest.approx(o.std()))
        assert (p[load].skewness, p[load].kurtosis) == (pytest.approx((z**3).mean(), abs=1e-4), pytest.approx((z**4).mean(), abs=1e-3))
    assert (p[4].n_violations, p[5].n_violations, p[6].mean) == (2, 1, None)
