"""Resampling at the reference's counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL

import __spark_entry__ as entry
from enanto.operators import curve, resampling


def pair_rows(spark, rows):
    p = spark.createDataFrame(rows, "g string, case_id string, t timestamp_ntz, L double, O_L double, O_R double")
    half = (F.col("O_L") + F.col("O_R")) / 2
    return p.withColumn("eta", F.abs(F.col("O_L") - F.col("O_R")) / half).withColumn("signed_parity", (F.col("O_L") - F.col("O_R")) / half)


def fixture():
    import datetime as dt

    rng, rows = np.random.default_rng(3), []
    for g, n in (("apart", 60), ("alike", 61), (None, 41)):
        for i in range(n):
            # In "apart" the sides are always half the range apart: shuffling brings most closer, so that eta is extreme.
            a = 1 + i % 20 / 20 if g == "apart" else float(rng.uniform(1, 2))
            b = 1 + (i + 10) % 20 / 20 if g == "apart" else a * float(rng.uniform(0.9, 1.1))
            rows.append((g, f"c{i}", dt.datetime(2001, 1, 1) + dt.timedelta(minutes=i), float(i % 3), a, b))
    return rows


def test_significance_can_pass_and_matches_direct_medians(spark):
    rows = fixture()
    p = pair_rows(spark, rows)
    got = {r.g: r for r in resampling.parity_significance(p, "g").collect()}
    assert got["apart"].p_perm == pytest.approx(1 / 201) and got["apart"].mirror_pass and got["apart"].signal_pass
    assert got["alike"].p_perm > 0.5 and not got["alike"].mirror_pass
    for g, r in got.items():
        mine = [x for x in rows if x[0] == g]
        e = np.array([abs(x[4] - x[5]) / ((x[4] + x[5]) / 2) for x in mine])
        assert r.n_pairs == len(mine) and r.mirror_stat == pytest.approx(np.median(e)) and r.obs_dir == pytest.approx(abs(np.mean([np.sign(x[4] - x[5]) for x in mine])))
        assert r.signal_pass == (r.mirror_pass or r.direction_pass) and r.direction_pass == (r.p_dir < 0.05 and r.obs_dir >= 0.3)
        assert r.p_dir * 201 == pytest.approx(round(r.p_dir * 201)) and r.p_perm * 201 == pytest.approx(round(r.p_perm * 201))
    again = {r.g: r for r in resampling.parity_significance(p.repartition(7), "g").collect()}
    assert again == got


def test_significance_near_direct_simulation(spark):
    rng = np.random.default_rng(5)
    rows = fixture()
    r = {x.g: x for x in resampling.parity_significance(pair_rows(spark, rows), "g", n=2000).collect()}[None]
    mine = [x for x in rows if x[0] is None]
    left, right, size = (np.array([x[i] for x in mine]) for i in (4, 5, 3))
    stat, obs, hits, dirs = np.median(np.abs(left - right) / ((left + right) / 2)), abs(np.sign(left - right).sum()), 0, 0
    for _ in range(2000):
        y = right.copy()
        for v in np.unique(size):
            y[size == v] = rng.permutation(y[size == v])
        hits += np.median(np.abs(left - y) / ((left + y) / 2)) >= stat
        dirs += abs((np.sign(left - right) * rng.choice([-1, 1], len(left))).sum()) >= obs
    assert abs(r.p_perm - (hits + 1) / 2001) < 0.05 and abs(r.p_dir - (dirs + 1) / 2001) < 0.06


def test_series_counts(spark):
    L = np.geomspace(8, 230, 15)
    eta = 0.01 * L**1.3 * np.exp(np.random.default_rng(1).normal(0, 0.05, 15))
    data = [("a", float(a), float(e), 1) for a, e in zip(L, eta)] + [("one", 8.0, 0.1, 1)]
    p = curve.log_points(spark.createDataFrame(data, "s string, L double, eta double, n bigint"), "s")
    s = {r.s: r for r in resampling.slope_intervals(p, "s").collect()}
    assert set(s) == {"a"} and s["a"].n_reps == 2000 and s["a"].lo < 1.3 < s["a"].hi
    few = {r.s: r for r in resampling.bootstrap_slopes(p, "s", n=1000).collect()}["a"]
    assert abs(few.lo - s["a"].lo) < 0.02 and abs(few.hi - s["a"].hi) < 0.02
    g = {r.s: r for r in resampling.gamma_significance(p, "s").collect()}
    assert g["a"].p_value == pytest.approx(1 / 201) and g["one"].p_value is None
    b = resampling.block_means(p, "s").collect()
    assert sum(r.s == "a" for r in b) == 200 and len({round(r.mean_y, 9) for r in b if r.s == "a"}) > 20
    y = np.log(eta)
    assert all(y.min() <= r.mean_y <= y.max() for r in b if r.s == "a")


@pytest.mark.parametrize("name", ["parity_significance", "slope_intervals", "gamma_significance", "block_means"])
def test_counts_are_registered(spark, name):
    df = entry.queries()[name](spark, SMALL)
    got = df.collect()
    assert got
    if name == "parity_significance":
        assert all(round(r.p_perm * 201) == pytest.approx(r.p_perm * 201, abs=1e-3) for r in got)
    if name == "slope_intervals":
        assert max(r.n_reps for r in got) > 1900
    if name == "block_means":
        assert {r.rep for r in got} == set(range(200))
