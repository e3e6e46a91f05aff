import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from enanto.operators import nulls
from enanto.plans import further
from enanto.sources import adapters, datasets


def dataset(spark):
    s = spark.createDataFrame([("a", 0, 1.0, "L", 2.0), ("a", 0, 1.0, "R", 3.0), ("a", 1, 1.0, "L", 4.0), ("a", 1, -1.0, "x", 4.0), ("b", 0, 2.0, "R", None)], "case_id string, t bigint, L double, hand string, O double")
    return datasets.Dataset("", {}, s)


def test_adapters_by_name(spark):
    a = adapters.adapter(" Weather ")
    assert set(adapters.domains()) >= {"weather", "josephson", "oam", "em_resonator", "plasma", "synthetic"}
    with pytest.raises(adapters.RegistryError):
        adapters.adapter("nowhere")
    with pytest.raises(adapters.RegistryError):
        adapters.register(adapters.TabularAdapter(" "))
    m = rows(a.mirror_map(dataset(spark)))
    assert m == [("a", 0, 1.0, "L", "R", True), ("a", 0, 1.0, "R", "L", True), ("a", 1, 1.0, "L", "R", False), ("b", 0, 2.0, "R", "L", False)]
    assert rows(a.size_proxy(dataset(spark))) == [("a", 1.0, 3), ("b", 2.0, 1)] and a.observable(dataset(spark)).count() == 5
    assert a.frequency_proxy(dataset(spark)) is None and a.impedance_proxy(dataset(spark)) is None
    d = datasets.Dataset("", {}, dataset(spark).samples.withColumn("omega", F.lit(3.0)))
    assert a.impedance_proxy(d).first().omega == 3.0
    assert adapters.event_column(["x", "SID", "event_id"]) == "SID" and adapters.event_column(["x"]) is None


def keyed(spark, n=60):
    rng = np.random.default_rng(1)
    data = [(f"c{i % 6}", i, "d", float(i % 6) if i % 6 else None, float(10 - i % 6), 1, 5.0, float(rng.normal()), float(rng.normal()), f"k{i}") for i in range(n)]
    return spark.createDataFrame(data, "case_id string, t bigint, domain string, lat0 double, lon0 double, hour int, L double, O_L double, O_R double, k string")


@pytest.mark.parametrize("name", sorted(nulls.PAIR_NULLS))
def test_pair_nulls_keep_rows_and_values(spark, name):
    p = keyed(spark)
    q = nulls.apply_null(f" {name.upper()} ", p).collect()
    b = p.collect()
    assert sorted(r.k for r in q) == sorted(r.k for r in b)
    if name == "direction":
        assert sorted(sorted((r.O_L, r.O_R)) for r in q) == sorted(sorted((r.O_L, r.O_R)) for r in b)
    else:
        assert sorted(r.O_R for r in q) == sorted(r.O_R for r in b) and sorted(r.O_L for r in q) == sorted(r.O_L for r in b)
    assert {r.k: r.O_R for r in q} != {r.k: r.O_R for r in b}
    assert nulls.apply_null(name, p.limit(0)).count() == 0


def test_moves_by_place(spark):
    p = keyed(spark, 12)
    b = {r.k: r for r in p.collect()}
    q = {r.k: r.O_R for r in nulls.latitude_mirror(p).collect()}
    assert all(q[k] == r.O_R for k, r in b.items() if r.lat0 is None)
    north = sorted(r.O_R for r in b.values() if r.lat0 == 5.0)
    assert sorted(q[k] for k, r in b.items() if r.lat0 == 1.0) == north
    with pytest.raises(ValueError):
        nulls.apply_null("other", p)


def test_curve_nulls(spark):
    rng = np.random.default_rng(2)
    L = np.geomspace(5, 200, 15)
    y = 1.5 * np.log(L) + rng.normal(0, 0.01, 15)
    p = spark.createDataFrame([("a", i, float(v), float(w)) for i, (v, w) in enumerate(zip(L, y))] + [("b", 0, 1.0, 1.0)], "s string, i int, L double, y double")
    n = nulls.curve_nulls(p, "s", 40)
    r = n.collect()
    assert [x.rep for x in r] == list(range(40)) and {x.model for x in r} == set(nulls.CURVE_NULLS) and {x.s for x in r} == {"a"}
    shuffled = [x.eta_mean for x in r if x.model == "time_shuffle"]
    assert np.allclose(shuffled, np.exp(y).mean())
    obs = spark.createDataFrame([("a", 1.5)], "s string, gamma double")
    t = nulls.against_nulls(obs, n, "s").first()
    assert t.n_nulls == 40 and 1 / 41 <= t.p_value < 0.6 and abs(t.null_mean) < 1
    with pytest.raises(ValueError):
        nulls.curve_nulls(p, "s", 4, ("other",))
    assert nulls.curve_nulls(p.limit(0), "s").count() == 0


def test_slow_ticks_and_crosstab(spark):
    data = [("a", "observed", 0.9, "1", 3.0)] + [("a", f"n{i}", v, "1", 1.0) for i, v in enumerate((0.1, 0.2, 0.3, 0.95))] + [("b", "observed", 0.5, "1", 1.0), ("b", "n0", None, "", 1.0)]
    f = spark.createDataFrame(data, "case_id string, variant string, R_Omega double, omegas string, ridge_strength double")
    got = {r.case_id: r for r in further.slow_ticks(f, p_max=0.5).collect()}
    a = got["a"]
    v = np.array([0.1, 0.2, 0.3, 0.95])
    assert (a.null_median, a.delta_R, a.p_empirical, a.survives_nulls) == (pytest.approx(0.25), pytest.approx(0.65), 0.4, True) and a.delta_z == pytest.approx(0.65 / v.std())
    assert got["b"].p_empirical is None and not got["b"].survives_nulls
    t = further.crosstab(spark.createDataFrame([("a", True, True), ("b", True, False), ("c", None, True), ("d", None, None)], "case_id string, size boolean, tf boolean")).first()
    assert tuple(t) == (4, 1, 1, 1, 1, pytest.approx(1 / 3))
    e = further.crosstab(spark.createDataFrame([], "case_id string, size boolean, tf boolean")).first()
    assert e.n_cases == 0 and e.coincidence == 0.0


def test_commutation_guards(spark):
    x = spark.createDataFrame([("a", float(i), -float(i), float(i % 3), float(i % 3)) for i in range(6)] + [("b", 1.0, None, float("nan"), 1.0)] + [("c", 1.0, 1.0, 1.0, 1.0)] * 4, "cell string, u_anom double, u_mirror_anom double, v_anom double, v_mirror_anom double")
    g = {r.cell: r for r in further.commutation(x).collect()}
    assert (g["a"].u_commute_rmse, g["a"].u_commute_corr, g["a"].v_commute_corr, g["a"].commute_pass) == (0.0, pytest.approx(1.0), pytest.approx(1.0), True)
    assert g["b"].u_commute_rmse is None and not g["b"].commute_pass and g["c"].u_commute_corr is None and g["c"].u_commute_rmse == 2.0


def test_kernels(spark):
    h = np.arange(-2, 3)
    yy, xx = np.meshgrid(h, h, indexing="ij")
    base = np.sin(np.arctan2(yy, xx) + np.hypot(xx, yy))
    r = spark.range(1).select(further.spiral_kernel(5).alias("l"), further.spiral_kernel(5, True).alias("r"), further.inner(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("p"), further.inner(F.array(F.lit(1.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("q")).first()
    assert np.allclose(r.l, base.ravel()) and np.allclose(r.r, np.fliplr(base).ravel()) and r.p == 11.0 and r.q is None
    with pytest.raises(ValueError):
        further.spiral_kernel(4)
