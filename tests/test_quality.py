import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from enanto.operators import grid, ordered, profile, spikes

NAN, INF = float("nan"), float("inf")
SAMPLES = "sample_id bigint, load_id bigint, case_id string, t timestamp_ntz, L double, hand string, O double, arrived_at timestamp_ntz, n bigint, kind string, slot_s bigint"
CASES = "case_id string, domain string, step_s int, O double"
DOMAINS = "domain string, o_min double, o_max double, case_id string"
T0 = dt.datetime(2001, 1, 1)


def samples(spark, data):
    return spark.createDataFrame([(*r, None, 1, "clash", 5) for r in data], SAMPLES)


def test_profile_counts_and_moments(spark):
    data = [(i, 1, "a", T0, float(i), "L", float(i), ) for i in range(1, 11)] + [(11, 1, None, None, NAN, "x", None), (12, 1, "a", T0, None, None, INF), (13, None, "a", T0, 1.0, "L", NAN)]
    p = {(r.load_id, r.column_name): r for r in profile.column_profile(samples(spark, data)).collect()}
    assert len(p) == 6
    o = p[1, "O"]
    assert (o.n_rows, o.n_missing, o.n_violations, o.n_distinct) == (12, 1, 1, 11)
    assert o.mean == pytest.approx(5.5) and o.std == pytest.approx(np.std(range(1, 11))) and o.skewness == pytest.approx(0, abs=1e-9)
    assert p[1, "hand"].n_violations == 1 and p[1, "hand"].n_missing == 1
    assert p[None, "O"].n_missing == 1 and p[None, "O"].mean is None
    assert profile.column_profile(samples(spark, [])).count() == 0


def test_findings(spark):
    rng = np.random.default_rng(1)
    data, n = [], 0
    for load in range(1, 8):
        for k in range(200):
            n += 1
            hand = "LR"[k % 2]
            L, O = float(rng.choice([10.0, 20.0, 40.0])), float(rng.uniform(5, 6))
            if load == 3:
                O *= 2.0
            if load == 4 and k % 5 == 0:
                L = NAN
            if load == 5 and k % 10 == 0:
                hand = "left"
            if load == 6:
                hand = "L" if k % 4 else "R"
            data.append((n, load, "a", T0, L, hand, O))
    data.append((n + 1, None, "a", T0, 1.0, "L", 1.0))
    loads = spark.createDataFrame([(i, "d", "clash") for i in range(1, 7)], "load_id bigint, domain string, n bigint".replace("n bigint", "finding string"))
    got = rows(profile.load_findings(samples(spark, data), loads))
    assert got == [(3, "O", "distribution"), (4, "L", "nulls"), (5, "hand", "pattern"), (6, "hand", "distribution")]
    assert profile.load_findings(samples(spark, []), loads).count() == 0
    s = {(r.load_id, r.column_name): r["shift"] for r in profile.standardised_shifts(samples(spark, data), loads).collect()}
    assert abs(s[3, "O"]) > 3 > abs(s[1, "O"])


def slots(data, step, limit=96):
    out = set()
    by = {}
    for _, _, c, t, _, _, o in data:
        if c in step and t is not None and o is not None and math.isfinite(o):
            s = step[c]
            by.setdefault(c, set()).add(int((t - dt.datetime(1970, 1, 1)).total_seconds() // s) * s)
    for c, x in by.items():
        y = sorted(x)
        for a, b in zip(y, y[1:]):
            if b - a <= limit * step[c]:
                out |= {(c, k) for k in range(a + step[c], b, step[c])}
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [100, 128, 4096])
def test_missing_slots_at_block_edges(spark, monkeypatch, block):
    monkeypatch.setattr(grid, "BLOCK", block)
    rng = np.random.default_rng(block)
    data, n = [], 0
    for c, step in (("a", 60), ("b", 7), ("c", 3600)):
        t = dt.datetime(1969, 12, 31, 20) if c == "a" else T0
        for _ in range(300):
            t += dt.timedelta(seconds=float(step * rng.choice([0.3, 1, 1, 2, 5, 60, 95, 96, 97, 300])))
            n += 1
            data.append((n, 1, c, t, 1.0, rng.choice(["L", "x", None]), float(rng.choice([1.0, 2.0, NAN]))))
    data += [(0, 1, None, T0, 1.0, "L", 1.0), (0, 1, "a", None, 1.0, "L", 1.0), (0, 1, "zz", T0, 1.0, "L", 1.0), (0, 1, "d", T0, 1.0, "L", 1.0)]
    cases = spark.createDataFrame([("a", "x", 60, 0.0), ("b", "x", 7, 0.0), ("c", "x", 3600, 0.0), ("d", "x", None, 0.0), (None, "x", 5, 0.0), ("a", "x", 60, 0.0)], CASES)
    assert rows(grid.missing_slots(samples(spark, data), cases)) == slots(data, {"a": 60, "b": 7, "c": 3600})


def test_grid_interpolates_in_time(spark):
    data = [(1, 1, "a", T0 + dt.timedelta(seconds=30), 1.0, "L", 10.0), (2, 1, "a", T0 + dt.timedelta(seconds=150), 1.0, "L", 22.0), (3, 1, "a", T0 + dt.timedelta(hours=9), 1.0, "R", 5.0)]
    cases = spark.createDataFrame([("a", "x", 60, 0.0)], CASES)
    g = grid.regular_grid(samples(spark, data), cases).orderBy("slot_s").collect()
    assert [(r.status, round(r.value, 6), r.n_readings, r.break_after) for r in g] == [("observed", 10.0, 1, False), ("filled", 16.0, 0, False), ("observed", 22.0, 1, True), ("observed", 5.0, 1, True)]
    assert grid.regular_grid(samples(spark, []), cases).count() == 0


def series(n, seed, spikes_at=(), stuck=None):
    rng = np.random.default_rng(seed)
    o = 10 + np.cumsum(rng.normal(0, 0.02, n)) + rng.normal(0, 0.1, n)
    for a, w in spikes_at:
        o[a : a + w] += 8.0
    if stuck:
        o[stuck[0] : stuck[0] + stuck[1]] = o[stuck[0]]
    return o


def spiky(spark):
    plan = {"a": (series(200, 1, [(20, 1), (60, 3), (100, 4)], (150, 10)), 60), "b": (series(39, 2, [(20, 1)], (5, 9)), 60), "c": (series(1500, 3, [(3, 1), (63, 2), (127, 3), (1490, 1)], (636, 12)), 60), "d": (series(120, 4, [(1, 1), (118, 2)]), 60)}
    data, n, want = [], 0, set()
    for c, (o, step) in plan.items():
        for k, v in enumerate(o):
            n += 1
            data.append((n, 1, c, T0 + dt.timedelta(seconds=step * k), 5.0, "L", float(v)))
            stuck = {"a": range(150, 160), "c": range(636, 648)}.get(c, ())
            spike = {"a": {20, 60, 61, 62}, "c": {3, 63, 64, 127, 128, 129, 1490}}.get(c, ())
            if k in stuck:
                want.add((n, "stuck"))
            elif k in spike:
                want.add((n, "spike"))
    first = {c: next(r for r in data if r[2] == c) for c in plan}
    again = data[20]  # a spike that was sent three times, once with another value
    for v in (again[6], again[6] + 0.01):
        n += 1
        data.append((n, 2, *again[2:6], v))
        want.add((n, "spike"))
    for v in (-1.0, INF, 1e36):
        n += 1
        data.append((n, 1, "a", T0 + dt.timedelta(days=3, seconds=n), 5.0, "L", v))
        want.add((n, "impossible"))
    n += 1
    data.append((n, 1, "unknown", T0, 5.0, "L", -50.0))
    for bad in ((None, T0, 5.0, "L", 1.0), ("a", None, 5.0, "L", 1.0), ("a", T0, NAN, "L", 1.0), ("a", T0, None, "L", 1.0), ("a", T0, 5.0, "l", -1.0), ("a", T0, 5.0, None, 1.0), ("a", T0, 5.0, "R", NAN), ("a", T0, 5.0, "R", None)):
        n += 1
        data.append((n, 1, *bad))
    assert first
    cases = spark.createDataFrame([(c, "dom", 60, 0.0) for c in plan], CASES)
    domains = spark.createDataFrame([("dom", 0.0, 50.0, "clash")], DOMAINS)
    return samples(spark, data), cases, domains, sorted(want)


@pytest.mark.parametrize("chunk", [64, 500, 100_000])
def test_spikes_whole_and_chunked(spark, monkeypatch, chunk):
    monkeypatch.setattr(spikes, "CHUNK", chunk)
    monkeypatch.setattr(spikes, "BUCKET_STEPS", 16)
    monkeypatch.setattr(spikes, "SUPER", 4)
    s, c, d, want = spiky(spark)
    assert sorted(map(tuple, spikes.implausible_readings(s, c, d).collect())) == want


def mixed(spark, seed):
    """Series with daily cycles, ties, heavy tails, outages, stuck runs and spikes of every width."""
    rng = np.random.default_rng(seed)
    data, n = [], 0
    for c in range(6):
        size, step = int(rng.integers(150, 1200)), int(rng.choice([60, 900, 3600]))
        at = np.cumsum(rng.choice([1, 1, 1, 2, 40], size) * step)
        o = 20 + np.cumsum(rng.normal(0, 0.05, size)) + (rng.normal(0, 0.1, size) if c % 2 else rng.standard_t(2, size) * 0.1)
        o[(at % 86_400) < step] += 3.0
        for _ in range(size // 40):
            i = int(rng.integers(0, size))
            o[i : i + int(rng.integers(1, 5))] += rng.choice([-4.0, 0.8, 1.5, 8.0])
        i = int(rng.integers(0, size - 15))
        o[i : i + int(rng.integers(8, 14))] = o[i]
        o = np.round(o, 1 if c < 3 else 6)
        for a, v in zip(at, o):
            n += 1
            data.append((n, 1, f"c{c}", T0 + dt.timedelta(seconds=int(a)), 5.0, "L", float(v)))
    cases = spark.createDataFrame([(f"c{c}", "dom", 60, 0.0) for c in range(6)], CASES)
    domains = spark.createDataFrame([("dom", -500.0, 500.0, "clash")], DOMAINS)
    return samples(spark, data), cases, domains


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_give_the_rows_of_whole_series(spark, monkeypatch, seed):
    s, c, d = mixed(spark, seed)
    whole = rows(spikes.implausible_readings(s, c, d))
    monkeypatch.setattr(spikes, "CHUNK", 64)
    monkeypatch.setattr(spikes, "BUCKET_STEPS", 8)
    monkeypatch.setattr(spikes, "SUPER", 4)
    assert rows(spikes.implausible_readings(s, c, d)) == whole
    assert sum(k == "spike" for _, k in whole) > 10 and sum(k == "stuck" for _, k in whole) > 10


def test_esd_limits_decide_where_the_scatter_says_nothing(spark):
    """More than half of the readings equal their level, so any change is more than twelve scatters of zero."""
    o = np.full(400, 10.0)
    o[5:395:3] += 1.0
    o[200:202] = 60.0
    for k in range(0, 400, 7):  # no constant run
        o[k] += 0.001 * (k % 5 + 1)
    data = [(i, 1, "a", T0 + dt.timedelta(minutes=i), 5.0, "L", float(v)) for i, v in enumerate(o)]
    cases = spark.createDataFrame([("a", "dom", 60, 0.0)], CASES)
    domains = spark.createDataFrame([("dom", 0.0, 100.0, "clash")], DOMAINS)
    assert rows(spikes.implausible_readings(samples(spark, data), cases, domains)) == [(200, "spike"), (201, "spike")]
    seg, us = np.zeros(400, np.int64), np.arange(400) * 60_000_000
    assert (spikes.judge(us, o, seg)["dev"] > 0).sum() > 20


def test_candidates_are_those_of_rosners_procedure():
    rng = np.random.default_rng(4)
    for n in (5, 12, 60, 300):
        r = np.concatenate((rng.normal(0, 1, n - n // 10), rng.normal(0, 9, n // 10)))
        left, last, removed = list(range(n)), 0, []
        for i in range(1, n // spikes.TESTED + 1):
            x = r[left]
            k = int(np.argmax(np.abs(x)))
            deviate = max(abs(abs(x[k]) - x.mean()), abs(abs(x[k]) + x.mean())) / x.std(ddof=1)
            removed.append(left.pop(k))
            if deviate > spikes.gesd_limits(np.array([n]), np.array([i]))[0]:
                last = i
        assert sorted(np.flatnonzero(spikes.candidates(r, np.zeros(n, np.int64), 1))) == sorted(removed[:last])


def test_ranks_and_exact_medians(spark):
    rng = np.random.default_rng(5)
    groups = {"a": np.round(rng.normal(0, 1, 501), 1), "b": rng.lognormal(0, 4, 300), None: np.array([-1.0, -0.0, 0.0, 5.0]), "c": np.array([-INF, 2.0, INF])}
    data = [(g, float(v), 1.0) for g, x in groups.items() for v in x] + [("a", NAN, 1.0), ("a", None, 1.0), ("d", None, 1.0)]
    df = spark.createDataFrame(data, "g string, x double, w double")
    got = {r.g: (r.m, r.n) for r in ordered.exact_medians(df, ["g"], "x", "m").collect()}
    assert got == {g: (pytest.approx(np.median(x)), len(x)) for g, x in groups.items()}
    for r in ordered.ranked(df, ["g"], "x", ("w",)).collect():
        x = groups[r.g]
        assert (r.below, r.c, r.n, r.upto_w) == ((x < r.x).sum(), (x == r.x).sum(), len(x), (x <= r.x).sum())
    assert ordered.exact_medians(df.limit(0), ["g"], "x", "m").count() == 0


def test_many_copies_of_few_readings(spark, monkeypatch):
    monkeypatch.setattr(spikes, "CHUNK", 64)
    o = series(30, 5, [(10, 1)])
    data = [(k * 30 + i + 1, 1, "a", T0 + dt.timedelta(minutes=i), 5.0, "L", float(v)) for k in range(5) for i, v in enumerate(o)]
    cases = spark.createDataFrame([("a", "dom", 60, 0.0)], CASES)
    domains = spark.createDataFrame([("dom", 0.0, 50.0, "clash")], DOMAINS)
    assert spikes.implausible_readings(samples(spark, data), cases, domains).count() == 0


def test_spikes_empty_and_small_batches(spark, monkeypatch):
    s, c, d, want = spiky(spark)
    assert spikes.implausible_readings(s.limit(0), c, d).count() == 0
    assert spikes.implausible_readings(s, c.limit(0), d.limit(0)).where("kind = 'stuck'").count() == 22
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert sorted(map(tuple, spikes.implausible_readings(s, c, d).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_gesd_limits_match_published_example():
    # Rosner (1983): n = 54, alpha = 0.05
    got = spikes.gesd_limits(np.full(3, 54), np.array([1, 2, 3]))
    assert np.allclose(got, [3.159, 3.151, 3.144], atol=0.005)


def test_carried_batches_agree():
    rng = np.random.default_rng(0)
    import pyarrow as pa

    n = 5000
    t = pa.table({"case_id": np.repeat([f"c{i:03}" for i in range(50)], 100), "L": np.ones(n), "hand": ["L"] * n, "chunk": np.zeros(n, np.int64), "us": np.tile(np.arange(100) * 60_000_000, 50), "o": rng.normal(0, 1, n) + 50 * (rng.random(n) < 0.01), "first_id": np.arange(n), "last_id": np.arange(n), "n_rows": np.ones(n, np.int64), "hot": np.zeros(n, bool), "own": np.ones(n, bool)})
    one = pa.Table.from_batches(spikes._judge_batches(iter(t.to_batches()))).to_pandas()
    old = spikes.BATCH
    try:
        spikes.BATCH = 130
        many = pa.Table.from_batches(spikes._judge_batches(iter(t.to_batches(max_chunksize=70)))).to_pandas()
    finally:
        spikes.BATCH = old
    pd.testing.assert_frame_equal(one, many)


def test_small_tables_have_all_columns(spark):
    assert spark.read.parquet(f"{SMALL}/samples.parquet").where(F.col("sample_id").isNull()).count() == 0
