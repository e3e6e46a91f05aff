"""Registered queries of null variants, time-frequency knees, filters and small aggregates, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.aggregates import median
from ..functions.scalars import finite, null_nan
from ..operators import curve, evaluation, grid, knees, nulls, pairing, spatial
from ..session import table, written
from . import extra, spatial as spatial_plans
from .contrast import HINGE_ALL, LINE, PAIRS, POINTS, S, half_up, pairs, points, rounded
from .evaluation import _RUNS, _runs, BOUNDARY, BUFFER

FIRST_DAY, LAST_DAY = "2001-01-20", "2001-02-03"
# Limits of the reports.
TF_GAIN, TF_CV, TF_SIDE = 10.0, 0.35, 3
DELTA_MIN, P_MAX = 0.03, 0.2
RMSE_MAX, CORR_MIN = 1.0, 0.9


def _keyed(s, d):
    return nulls.keyed(pairs(s, d), table(s, d, "cases"))


def _null(name: str):
    return lambda s, d: nulls.apply_null(name, _keyed(s, d)).select("case_id", "t", "domain", "L", "O_L", "O_R")


def _null_runs(s, d):
    return rounded(nulls.curve_nulls(points(s, d), S))


def _null_significance(s, d):
    p = points(s, d)
    observed = curve.line_fits(p, S).select(S, F.col("slope").alias("gamma"))
    return rounded(nulls.against_nulls(observed, nulls.curve_nulls(p, S), S))


# -- spectra of variants -----------------------------------------------------------------------------------------------


def _series_grid(s, d, variants, value: Column, by_size: bool = False):
    """Regular steps of a value of each case and variant (and size), as cases named case|variant(|size)."""
    name = F.concat_ws("|", "case_id", "variant", *([F.col("L").cast("string")] if by_size else []))
    x = variants.select(name.alias("series"), "case_id", "t", value.alias("O")).where(finite(F.col("O")))
    steps = table(s, d, "cases").where("case_id is not null and step_s > 0").groupBy(F.col("case_id").alias("__c")).agg(F.min("step_s").alias("step_s"))
    x = written(x.join(steps, F.col("case_id") == F.col("__c")).select("series", "t", "O", "step_s"), "series")
    cases = x.select(F.col("series").alias("case_id"), "step_s").distinct()
    g = grid.regular_grid(x.select(F.col("series").alias("case_id"), "t", "O"), cases)
    return g.join(cases.select(F.col("case_id").alias("__c"), F.col("step_s").cast("long")), F.col("case_id") == F.col("__c")).drop("__c")


def _tf_best(steps):
    """Strongest joined-line knee of each series' power spectrum (frequency per hour), whatever its gain."""
    hours = steps.groupBy(F.col("case_id").alias("__h")).agg(F.max("step_s").alias("step_s"))
    sp = knees.welch(steps, 128, 24, 16).where("freq > 0 and power > 0")
    p = curve.log_points(sp.select("case_id", F.col("freq").alias("L"), F.col("power").alias("eta"), F.col("n_segments").alias("n")), "case_id").where("n_points >= 10")
    k = curve.knee_candidates(p, "case_id", apart=TF_SIDE)
    best = k.groupBy("case_id").agg(F.max(F.struct(F.round("delta_bic", 9).alias("g"), (-F.col("k")).alias("o"), "delta_bic", F.col("L_k").alias("freq"), "slope_left", "slope_right")).alias("b"))
    j = best.join(hours, F.col("case_id") == F.col("__h"))
    return j.select(F.col("case_id").alias("series"), (F.col("b.freq") * 3600.0 / F.col("step_s")).alias("knee_freq_per_hour"), "b.delta_bic", "b.slope_left", "b.slope_right", (F.col("b.delta_bic") >= TF_GAIN).alias("detected"))


def _eta() -> Column:
    half = (F.col("O_L") + F.col("O_R")) / 2.0
    return F.when(half > 1e-12, F.abs(F.col("O_L") - F.col("O_R")) / half)


def _part(i: int) -> Column:
    return F.split("series", "[|]")[i]


def _observed(s, d):
    return _keyed(s, d).withColumn("variant", F.lit("observed"))


def _tf_knees(s, d):
    """Knee of each case's spectrum of contrast over time, and whether those of its sizes agree (spread over median)."""
    x = written(_observed(s, d), "observed")
    whole = _tf_best(_series_grid(s, d, x, _eta()))
    sizes = _tf_best(_series_grid(s, d, x, _eta(), True)).groupBy(_part(0).alias("__c")).agg(F.count("*").alias("n_scales"), F.stddev_pop("knee_freq_per_hour").alias("sd"), F.median("knee_freq_per_hour").alias("m"))
    cv = F.when((F.col("n_scales") >= 2) & (F.abs("m") > 1e-12), F.col("sd") / F.abs("m"))
    j = whole.withColumn("case_id", _part(0)).join(sizes, F.col("case_id") == F.col("__c"), "left")
    j = j.select("case_id", "detected", F.when(~F.col("detected"), "bic_weak").alias("reason"), "knee_freq_per_hour", "delta_bic", "slope_left", "slope_right", F.coalesce("n_scales", F.lit(0)).alias("n_scales"), cv.alias("consistency_cv"))
    return rounded(j.withColumn("consistent", F.coalesce(F.col("consistency_cv") <= TF_CV, F.lit(False))))


def _tf_gate(s, d):
    """Per case whether its spectrum has a knee as it is and under two nulls; it passes where neither null has one."""
    v = nulls.variants(_keyed(s, d), ("fake_mirror", "longitude_shift"))
    k = _tf_best(_series_grid(s, d, v, _eta())).withColumn("variant", _part(1)).withColumn("case_id", _part(0))
    hit = lambda name: F.coalesce(F.max(F.when(F.col("variant") == name, F.col("detected"))), F.lit(False))
    g = k.groupBy("case_id").agg(hit("observed").alias("observed"), hit("fake_mirror").alias("fake_mirror"), hit("longitude_shift").alias("longitude_shift"))
    return g.withColumn("gate_pass", ~F.col("fake_mirror") & ~F.col("longitude_shift"))


def slow_ticks(found, delta_min: float = DELTA_MIN, p_max: float = P_MAX):
    """Observed R_Omega of each case against those of its nulls (columns case_id, variant, R_Omega, omegas, ridge_strength)."""
    seen = F.col("variant") == "observed"
    o = found.where(seen).select("case_id", "R_Omega", "omegas", "ridge_strength")
    n = found.where(~seen & F.col("R_Omega").isNotNull()).select(F.col("case_id").alias("__c"), F.col("R_Omega").alias("r"))
    j = o.join(n, F.col("case_id") == F.col("__c"), "left")
    g = j.groupBy("case_id", "R_Omega", "omegas", "ridge_strength").agg(F.count("r").alias("n_nulls"), F.median("r").alias("null_median"), F.stddev_pop("r").alias("sd"), F.count_if(F.col("r") >= F.col("R_Omega")).alias("reach"))
    delta = F.col("R_Omega") - F.col("null_median")
    p = F.when(F.col("n_nulls") > 0, (F.col("reach") + 1) / (F.col("n_nulls") + 1))
    x = g.select("case_id", "omegas", "R_Omega", "ridge_strength", "n_nulls", "null_median", delta.alias("delta_R"), (delta / (F.col("sd") + 1e-12)).alias("delta_z"), p.alias("p_empirical"))
    return x.withColumn("survives_nulls", F.coalesce((F.col("delta_R") >= delta_min) & (F.col("p_empirical") <= p_max), F.lit(False)))


def _slow_ticks(s, d):
    v = nulls.variants(_keyed(s, d), tuple(nulls.PAIR_NULLS))
    half = (F.col("O_L") + F.col("O_R")) / 2.0
    t = knees.ticks(knees.welch(_series_grid(s, d, v, F.when(half > 1e-12, (F.col("O_L") - F.col("O_R")) / half))))
    t = t.withColumn("series", F.col("case_id")).withColumn("variant", _part(1)).withColumn("case_id", _part(0))
    return rounded(slow_ticks(t))


# -- knees over sizes of single cases ----------------------------------------------------------------------------------


def _case_points(s, d):
    p = pairs(s, d).groupBy("case_id", "L").agg(median(F.col("eta")).alias("eta"), F.count("*").alias("n"))
    return curve.log_points(p, "case_id")


def _size_knees(s, d):
    """The ten best knee candidates over the sizes of each case, the first marked as detected where its gain reaches 10."""
    k = curve.knee_candidates(_case_points(s, d), "case_id", slope_max=8.0, apart=2)
    w = Window.partitionBy("case_id").orderBy(F.round("delta_bic", 9).desc(), "k")  # one curve
    r = k.select("case_id", "k", "L_k", "delta_bic", "slope_left", "slope_right", F.row_number().over(w).alias("rank")).where("rank <= 10")
    return rounded(r.withColumn("detected", (F.col("rank") == 1) & (F.col("delta_bic") >= TF_GAIN)))


def crosstab(found):
    """Cases (case_id, size, tf: booleans) by which detector finds a knee, and how often both do where one does."""
    a, b = F.coalesce("size", F.lit(False)), F.coalesce("tf", F.lit(False))
    g = found.agg(F.count("*").alias("n_cases"), F.count_if(a & b).alias("both_detected"), F.count_if(a & ~b).alias("size_only"), F.count_if(~a & b).alias("tf_only"), F.count_if(~a & ~b).alias("neither"))
    return g.withColumn("coincidence", F.col("both_detected") / F.greatest(F.lit(1), F.col("both_detected") + F.col("size_only") + F.col("tf_only")))


def _crosstab(s, d):
    size = _size_knees(s, d).where("rank = 1").select("case_id", F.col("detected").alias("size"))
    tf = _tf_best(_series_grid(s, d, _observed(s, d), _eta())).select(_part(0).alias("__c"), F.col("detected").alias("tf"))
    cases = table(s, d, "cases").where("case_id is not null").select("case_id").distinct()
    return rounded(crosstab(cases.join(size, "case_id", "left").join(tf, F.col("case_id") == F.col("__c"), "left")))


# -- filters, choices and small aggregates -----------------------------------------------------------------------------


def _date_range(s, d):
    """Readings from the first day to the end of the last."""
    x = table(s, d, "samples")
    return x.where((F.col("t") >= F.lit(FIRST_DAY).cast("timestamp_ntz")) & (F.col("t") < F.lit(LAST_DAY).cast("timestamp_ntz") + F.expr("interval 1 day"))).select("sample_id", "case_id", "t")


def _post_knee(s, d):
    """Points of each run above its knee widened by half, or all of them where there is none or nothing lies above."""
    p = points(s, d).join(_runs(s, d).select(F.col(S).alias("__r"), "L_k"), F.col(S) == F.col("__r"))
    above = F.coalesce(F.col("L") > F.col("L_k") * 1.5, F.lit(False))
    some = F.max(above.cast("int")).over(Window.partitionBy(S))  # one curve
    return rounded(p.withColumn("keep", (some == 0) | above).where("keep").select(S, "i", "L", "y"))


def _excluded(s, d):
    """Each case with the reasons that keep it out of tiles, empty where nothing does."""
    c = table(s, d, "cases")
    why = F.concat_ws(";", F.when(F.col("lat0").isNull(), "no_latitude"), F.when(F.col("lon0").isNull(), "no_longitude"), F.when(F.col("onset_time").isNull(), "no_onset"), F.when(~F.col("case_type").isin("storm", "near_storm"), "not_an_event"))
    return c.where("case_id is not null").select("case_id", why.alias("excluded_reason"), (why != "").alias("excluded"))


def _one_per_time(s, d):
    """Of each case and time the reading with the largest O (the first sample of equal ones)."""
    r = pairing.fit_readings(table(s, d, "samples"))
    g = r.groupBy("case_id", "t").agg(F.max(F.struct("O", (-F.col("sample_id")).alias("i"), "L", "hand")).alias("m"), F.count("*").alias("n_rows"))
    return g.select("case_id", "t", (-F.col("m.i")).alias("sample_id"), F.col("m.L").alias("L"), F.col("m.hand").alias("hand"), F.col("m.O").alias("O"), "n_rows")


def _random_per_time(s, d):
    """Of each case and time one reading, chosen by hash."""
    r = pairing.fit_readings(table(s, d, "samples"))
    return r.groupBy("case_id", "t").agg(F.min_by("sample_id", F.md5(F.concat(F.lit("42:"), F.col("sample_id").cast("string")))).alias("sample_id"))


def _group_leaks(s, d):
    """Cases whose rows came in loads of more than one domain, and how many there are."""
    n = table(s, d, "loads").groupBy(F.col("load_id").alias("__l")).agg(F.min("domain").alias("domain"))
    x = table(s, d, "samples").where("case_id is not null").join(n, F.col("load_id") == F.col("__l"))
    return x.groupBy("case_id").agg(F.count_distinct("domain").alias("n_domains"), F.count("*").alias("n_rows")).withColumn("mixed", F.col("n_domains") > 1)


def _common_cases(s, d):
    """Cases that are listed and have readings."""
    return table(s, d, "samples").where("case_id is not null").select("case_id").intersect(table(s, d, "cases").select("case_id"))


def _mean_size(s, d):
    """Mean of the absolute values of a row's scalars, those that are null or NaN left out."""
    cols = [F.abs(null_nan(F.col(c))) for c in ("eta", "eta_mean", "gamma")]
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return half_up(table(s, d, "results").select("result_id", F.try_divide(total, n).alias("mean_size")))


def spiral_kernel(size: int, right: bool = False) -> Column:
    """sin(angle + radius) over an odd square around its centre, row by row; mirrored left to right for the right hand."""
    if size % 2 == 0:
        raise ValueError("a spiral kernel has an odd size")
    h = size // 2
    columns = range(h, -h - 1, -1) if right else range(-h, h + 1)
    cell = lambda y, x: F.sin(F.atan2(F.lit(float(y)), F.lit(float(x))) + F.sqrt(F.lit(float(x * x + y * y))))
    return F.array(*[cell(y, x) for y in range(-h, h + 1) for x in columns])


def inner(a: Column, b: Column) -> Column:
    """Inner product of two arrays; null where their sizes differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v))


def _kernel_products(s, d):
    """Inner products of each run's first nine log contrasts with their mirror image and with the spiral kernels of size three."""
    p = points(s, d).where("i < 9").groupBy(S).agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("p")).select(S, F.transform("p", lambda e: e["y"]).alias("v"))
    return rounded(p.select(S, inner(F.col("v"), F.reverse("v")).alias("mirrored"), inner(F.col("v"), spiral_kernel(3)).alias("spiral_left"), inner(F.col("v"), spiral_kernel(3, True)).alias("spiral_right")))


def coerced_band(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A band whose ends are finite and in order, else null and null."""
    ok = finite(lo) & finite(hi) & (hi > lo)
    return F.when(ok, lo), F.when(ok, hi)


def _bands(s, d):
    """The band of each run's contrast from eta_mean - eta_std to eta_mean + eta_std of its smallest row, where it is one."""
    lo, hi = coerced_band(F.col("eta_mean") - F.col("eta_std"), F.col("eta_mean") + F.col("eta_std"))
    return rounded(table(s, d, "results").select("result_id", lo.alias("band_lo"), hi.alias("band_hi")))


def commutation(x):
    """Per cell how well anomalies commute with mirroring: rmse and correlation of u with -u of the image and of v with v.

    Correlations need three rows and sides that vary; cells without any pair have nulls, and pass is then false.
    """
    u, v, um, vm = (null_nan(F.col(c)) for c in ("u_anom", "v_anom", "u_mirror_anom", "v_mirror_anom"))

    def pair(a: Column, b: Column, name: str) -> list[Column]:
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        fit = (F.count(a) >= 3) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
        return [F.sqrt(F.avg((a - b) * (a - b))).alias(f"{name}_commute_rmse"), F.when(fit, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))).alias(f"{name}_commute_corr")]

    g = x.groupBy("cell").agg(*pair(u, -um, "u"), *pair(v, vm, "v"), F.count("*").alias("n_rows"))
    ok = (F.col("u_commute_rmse") <= RMSE_MAX) & (F.col("v_commute_rmse") <= RMSE_MAX) & (F.col("u_commute_corr") >= CORR_MIN) & (F.col("v_commute_corr") >= CORR_MIN)
    return g.withColumn("commute_pass", F.coalesce(ok, F.lit(False)))


def _mirror_anomalies(s, d):
    m = written(spatial.mirrored(spatial_plans._hours(s, d)).where("m_cell is not null"), "mirrored")
    a = spatial.anomalies(m)
    b = spatial.anomalies(m.select("cell", "time", "lat", "lon", F.col("u10_mirror").alias("u10"), F.col("v10_mirror").alias("v10")))
    b = b.select(F.col("cell").alias("__c"), F.col("time").alias("__t"), F.col("u_anom").alias("u_mirror_anom"), F.col("v_anom").alias("v_mirror_anom"))
    return a.join(b, (F.col("cell") == F.col("__c")) & (F.col("time") == F.col("__t")))


def _commutation(s, d):
    return rounded(commutation(_mirror_anomalies(s, d)))


def _commutation_summary(s, d):
    """Over all cells the rate of those that pass and the medians of their figures."""
    c = commutation(_mirror_anomalies(s, d))
    mid = [median(F.col(f"{n}_commute_{k}")).alias(f"{n}_{k}_median") for n in "uv" for k in ("rmse", "corr")]
    return rounded(c.agg(F.count("*").alias("n_cells"), F.avg(F.col("commute_pass").cast("double")).alias("pass_rate"), *mid))


# -- summaries of agreement, splits and strata -------------------------------------------------------------------------


def _mode_agreement(s, d):
    """Of the runs with a candidate in every mode, how many agree, by the domain of the run."""
    m = extra._mode_acceptance(s, d).where("n_modes = 2").join(_runs(s, d).select(F.col("run_id").alias("__r"), "domain"), F.col("run_id") == F.col("__r"))
    g = m.groupBy("domain").agg(F.count("*").alias("n_runs"), F.avg((F.col("disagreement") <= extra.AGREE).cast("double")).alias("agreement_rate"), F.avg(F.col("accepted").cast("double")).alias("accepted_rate"))
    return rounded(g)


def _ks_cases(s, d):
    """Left against right readings of each case: exact distance."""
    return rounded(evaluation.ks_distance(pairing.fit_readings(table(s, d, "samples")), "case_id", F.col("O"), F.col("hand") == "L"))


def _split_overlaps(s, d):
    """Per storm with a split case: cases of each side, and whether the storm is on both (a leak) or has a test case too near."""
    split = evaluation.blocked_split(table(s, d, "cases"), BOUNDARY, BUFFER)
    names = table(s, d, "cases").where("case_id is not null").groupBy(F.col("case_id").alias("__c")).agg(F.min("storm_id").alias("storm_id"))
    gaps = evaluation.split_gaps(split).groupBy(F.col("case_id").alias("__g")).agg(F.min("gap_hours").alias("gap"))
    x = split.join(names, F.col("case_id") == F.col("__c")).join(gaps, F.col("case_id") == F.col("__g"), "left").where("storm_id is not null")
    g = x.groupBy("storm_id").agg(*[F.count_if(F.col("split") == k).alias(f"n_{k}") for k in ("train", "test", "buffer")], F.count_if(F.col("gap") < 24.0 * BUFFER).alias("n_too_near"))
    return g.withColumn("mixed", (F.col("n_train") > 0) & (F.col("n_test") > 0))


def _strata_metrics(s, d):
    """Per stratum of cases: cases with pairs, median of their mean contrast, mean sign consistency, and pairs."""
    p = pairs(s, d).groupBy("case_id").agg(F.count("*").alias("n"), F.avg("eta").alias("eta"), F.abs(F.avg(F.signum("signed_parity"))).alias("sign"))
    t = F.col("case_type")
    labels = F.array_compact(F.array(F.lit("all"), F.when(t.isin("storm", "near_storm"), F.lit("events")), F.when(t == "near_storm", F.lit("near_storm_only")), F.when(t == "control", F.lit("far_nonstorm"))))
    c = table(s, d, "cases").where("case_id is not null").select(F.col("case_id").alias("__c"), F.explode(labels).alias("stratum"))
    g = p.join(c, F.col("case_id") == F.col("__c")).groupBy("stratum").agg(F.count("*").alias("n_cases"), median(F.col("eta")).alias("eta_median"), F.avg("sign").alias("sign_consistency"), F.sum("n").alias("n_pairs"))
    return rounded(g)


def _case_flags(s, d):
    """Each case's kind as flags, its storm (its own id where it has none) and its first and last reading."""
    at = table(s, d, "samples").where("case_id is not null").groupBy(F.col("case_id").alias("__c")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    c = table(s, d, "cases").where("case_id is not null")
    flag = lambda k: F.coalesce((F.col("case_type") == k).cast("int"), F.lit(0)).alias(k)
    return c.join(at, F.col("case_id") == F.col("__c"), "left").select("case_id", *[flag(k) for k in ("storm", "near_storm", "control")], F.coalesce("storm_id", "case_id").alias("storm_id"), "first_t", "last_t")


def queries() -> dict:
    return {
        "mode_agreement": _mode_agreement,
        "ks_cases": _ks_cases,
        "split_overlaps": _split_overlaps,
        "strata_metrics": _strata_metrics,
        "case_flags": _case_flags,
        "null_direction": _null("direction"),
        "null_time_permutation": _null("time_permutation"),
        "null_latitude_mirror": _null("latitude_mirror"),
        "null_longitude_shift": _null("longitude_shift"),
        "null_runs": _null_runs,
        "null_significance": _null_significance,
        "tf_knees": _tf_knees,
        "tf_null_gate": _tf_gate,
        "slow_ticks": _slow_ticks,
        "size_knees": _size_knees,
        "detector_crosstab": _crosstab,
        "commutation": _commutation,
        "commutation_summary": _commutation_summary,
        "date_range": _date_range,
        "post_knee_points": _post_knee,
        "excluded_cases": _excluded,
        "one_per_time": _one_per_time,
        "random_per_time": _random_per_time,
        "group_leaks": _group_leaks,
        "common_cases": _common_cases,
        "mean_size": _mean_size,
        "kernel_products": _kernel_products,
        "coerced_bands": _bands,
    }


_FIT = "case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND O IS NOT NULL AND isfinite(L) AND isfinite(O) AND hand IN ('L', 'R')"
_X = f"""{PAIRS}, x AS (SELECT pairs.case_id, t, domain, lat0, lon0, hour(t)::INT AS hour, L, O_L, O_R, pairs.case_id || '|' || epoch_us(t)::VARCHAR || '|' || round(L * 10000)::BIGINT::VARCHAR AS k
  FROM pairs LEFT JOIN cases c ON pairs.case_id = c.case_id)"""


def _placed(place: str, source: str) -> str:
    same = " AND ".join(f"p.{c} IS NOT DISTINCT FROM q.{c}" for c in ("domain", "hour", "L"))
    return f"""WITH {_X}, n AS (SELECT *, row_number() OVER (PARTITION BY domain, hour, L ORDER BY {place}, md5('42:{place}:' || k), k) AS r, count(*) OVER (PARTITION BY domain, hour, L) AS n FROM x WHERE {place} IS NOT NULL)
        SELECT p.case_id, p.t, p.domain, p.L AS "L", p.O_L AS "O_L", q.O_R AS "O_R" FROM n p JOIN n q ON {same} AND q.r = {source} UNION ALL SELECT case_id, t, domain, L, O_L, O_R FROM x WHERE {place} IS NULL"""


def _side(side: str) -> str:
    return f"""row_number() OVER (PARTITION BY domain, L ORDER BY md5('42:to:{side}:' || k), k) AS ta, row_number() OVER (PARTITION BY domain, L ORDER BY md5('42:{side}:' || k), k) AS fr"""


def oracle_sql() -> dict:
    m = spatial_plans
    mir = f"WITH {m._HOURS}{m._mirror('180.0')}, mm AS (SELECT * FROM mir WHERE m_cell IS NOT NULL)"
    w = "(PARTITION BY round_even(lat / 20, 0), round_even(lon / 60, 0), hour(time), month(time))"
    com = mir + f""", a AS (SELECT cell, u10 - avg(u10) OVER {w} AS u, v10 - avg(v10) OVER {w} AS v, u10_mirror - avg(u10_mirror) OVER {w} AS um, v10_mirror - avg(v10_mirror) OVER {w} AS vm FROM mm),
        g AS (SELECT cell, sqrt(avg(pow(u + um, 2))) AS ur, sqrt(avg(pow(v - vm, 2))) AS vr, CASE WHEN count(*) >= 3 AND stddev_pop(u) > 1e-12 AND stddev_pop(um) > 1e-12 THEN covar_pop(u, -um) / (stddev_pop(u) * stddev_pop(um)) END AS uc,
          CASE WHEN count(*) >= 3 AND stddev_pop(v) > 1e-12 AND stddev_pop(vm) > 1e-12 THEN covar_pop(v, vm) / (stddev_pop(v) * stddev_pop(vm)) END AS vc, count(*) AS n FROM a GROUP BY 1),
        p AS (SELECT *, coalesce(ur <= {RMSE_MAX} AND vr <= {RMSE_MAX} AND uc >= {CORR_MIN} AND vc >= {CORR_MIN}, false) AS ok FROM g)"""
    case_points = POINTS.replace("FROM results WHERE run_id IS NOT NULL AND isfinite(eta)", "FROM (SELECT case_id AS run_id, L, eta FROM pairs)")
    nine = "CASE WHEN len(v) = 9 THEN list_sum(list_transform(range(1, 10), lambda i: v[i] * {}[i])) END"
    spiral = lambda right: "[" + ", ".join(f"sin(atan2({y}.0, {x}.0) + sqrt({x * x + y * y}.0))" for y in (-1, 0, 1) for x in ((1, 0, -1) if right else (-1, 0, 1))) + "]"
    return {
        "mode_agreement": extra.oracle_sql()["mode_acceptance"].replace("WITH ", f"WITH {_RUNS}, acc AS (WITH ", 1)
        + ") SELECT domain, count(*) AS n_runs, round(avg((disagreement <= 0.35)::INT), 6) AS agreement_rate, round(avg(accepted::INT), 6) AS accepted_rate FROM acc JOIN runs ON acc.run_id = runs.run_id WHERE n_modes = 2 GROUP BY 1",
        "ks_cases": f"""WITH k AS (SELECT case_id, O AS v, count(*) FILTER (hand = 'L') AS a, count(*) FILTER (hand = 'R') AS b FROM samples WHERE {_FIT} GROUP BY 1, 2),
            u AS (SELECT case_id, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER c AS na, sum(b) OVER c AS nb FROM k WINDOW w AS (PARTITION BY case_id ORDER BY v), c AS (PARTITION BY case_id))
            SELECT case_id, max(na)::BIGINT AS n_first, max(nb)::BIGINT AS n_second, round(max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))), 6) AS ks FROM u GROUP BY 1""",
        "split_overlaps": f"""WITH s AS (SELECT case_id, domain, storm_id, onset_time, CASE WHEN onset_time < TIMESTAMP '{BOUNDARY}' - INTERVAL {BUFFER} DAY THEN 'train' WHEN onset_time >= TIMESTAMP '{BOUNDARY}' + INTERVAL {BUFFER} DAY THEN 'test' ELSE 'buffer' END AS split
              FROM cases WHERE onset_time IS NOT NULL),
            g AS (SELECT a.case_id, min(abs(epoch_us(a.onset_time) - epoch_us(b.onset_time)) / 3.6e9) AS gap FROM s a JOIN s b ON a.domain = b.domain AND b.split = 'train' WHERE a.split = 'test' GROUP BY 1)
            SELECT storm_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'buffer') AS n_buffer, count(*) FILTER (gap < 24.0 * {BUFFER}) AS n_too_near,
              count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'test') > 0 AS mixed FROM s LEFT JOIN g ON s.case_id = g.case_id WHERE storm_id IS NOT NULL GROUP BY 1""",
        "strata_metrics": f"""WITH {PAIRS}, m AS (SELECT case_id, count(*) AS n, avg(eta) AS eta, abs(avg(sign(signed_parity))) AS sg FROM pairs GROUP BY 1),
            c AS (SELECT case_id, unnest(list_filter(['all', CASE WHEN case_type IN ('storm', 'near_storm') THEN 'events' END, CASE WHEN case_type = 'near_storm' THEN 'near_storm_only' END, CASE WHEN case_type = 'control' THEN 'far_nonstorm' END], lambda v: v IS NOT NULL)) AS stratum FROM cases)
            SELECT stratum, count(*) AS n_cases, round(median(eta), 6) AS eta_median, round(avg(sg), 6) AS sign_consistency, sum(n)::BIGINT AS n_pairs FROM m JOIN c ON m.case_id = c.case_id GROUP BY 1""",
        "case_flags": """SELECT c.case_id, coalesce((case_type = 'storm')::INT, 0) AS storm, coalesce((case_type = 'near_storm')::INT, 0) AS near_storm, coalesce((case_type = 'control')::INT, 0) AS control, coalesce(storm_id, c.case_id) AS storm_id, first_t, last_t
            FROM cases c LEFT JOIN (SELECT case_id, min(t) AS first_t, max(t) AS last_t FROM samples GROUP BY 1) s ON c.case_id = s.case_id WHERE c.case_id IS NOT NULL""",
        "null_direction": f"""WITH {_X}, f AS (SELECT *, ('0x' || substr(md5('42:dir:' || k), 1, 7))::BIGINT % 2 = 1 AS flip FROM x)
            SELECT case_id, t, domain, L AS "L", CASE WHEN flip THEN O_R ELSE O_L END AS "O_L", CASE WHEN flip THEN O_L ELSE O_R END AS "O_R" FROM f""",
        "null_time_permutation": f"""WITH {_X}, a AS (SELECT *, {_side('O_L')} FROM x), b AS (SELECT *, {_side('O_R')} FROM x)
            SELECT p.case_id, p.t, p.domain, p.L AS "L", q.O_L AS "O_L", s.O_R AS "O_R" FROM a p JOIN a q ON p.domain IS NOT DISTINCT FROM q.domain AND p.L = q.L AND p.ta = q.fr
            JOIN b r ON p.k = r.k JOIN b s ON r.domain IS NOT DISTINCT FROM s.domain AND r.L = s.L AND r.ta = s.fr""",
        "null_latitude_mirror": _placed("lat0", "p.n + 1 - p.r"),
        "null_longitude_shift": _placed("lon0", "CASE WHEN p.r = 1 THEN p.n ELSE p.r - 1 END"),
        "size_knees": f"""WITH {PAIRS}, {case_points}{LINE}{HINGE_ALL}, rk AS (SELECT run_id AS case_id, k, L_k, delta_bic, slope_left, slope_right, row_number() OVER (PARTITION BY run_id ORDER BY round(delta_bic, 9) DESC, k)::INT AS rank FROM knees)
            SELECT case_id, k, round(L_k, 6) AS "L_k", round(delta_bic, 6) AS delta_bic, round(slope_left, 6) AS slope_left, round(slope_right, 6) AS slope_right, rank, rank = 1 AND delta_bic >= {TF_GAIN} AS detected FROM rk WHERE rank <= 10""",
        "commutation": com + " SELECT cell, round(ur, 6) AS u_commute_rmse, round(uc, 6) AS u_commute_corr, round(vr, 6) AS v_commute_rmse, round(vc, 6) AS v_commute_corr, n AS n_rows, ok AS commute_pass FROM p",
        "commutation_summary": com + " SELECT count(*) AS n_cells, round(avg(ok::INT), 6) AS pass_rate, round(median(ur), 6) AS u_rmse_median, round(median(uc), 6) AS u_corr_median, round(median(vr), 6) AS v_rmse_median, round(median(vc), 6) AS v_corr_median FROM p",
        "date_range": f"SELECT sample_id, case_id, t FROM samples WHERE t >= TIMESTAMP '{FIRST_DAY}' AND t < TIMESTAMP '{LAST_DAY}' + INTERVAL 1 DAY",
        "post_knee_points": f"""WITH {POINTS}, {_RUNS}, f AS (SELECT p.run_id, i, p.L, y, coalesce(p.L > L_k * 1.5, false) AS above FROM p JOIN runs ON p.run_id = runs.run_id), g AS (SELECT *, bool_or(above) OVER (PARTITION BY run_id) AS has_above FROM f)
            SELECT run_id, i, round(L, 6) AS "L", round(y, 6) AS y FROM g WHERE above OR NOT has_above""",
        "excluded_cases": """WITH w AS (SELECT case_id, concat_ws(';', CASE WHEN lat0 IS NULL THEN 'no_latitude' END, CASE WHEN lon0 IS NULL THEN 'no_longitude' END, CASE WHEN onset_time IS NULL THEN 'no_onset' END,
            CASE WHEN case_type NOT IN ('storm', 'near_storm') THEN 'not_an_event' END) AS excluded_reason FROM cases WHERE case_id IS NOT NULL) SELECT *, excluded_reason <> '' AS excluded FROM w""",
        "one_per_time": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id, t ORDER BY O DESC, sample_id) AS rk, count(*) OVER (PARTITION BY case_id, t) AS n_rows FROM samples WHERE {_FIT})
            SELECT case_id, t, sample_id, L AS "L", hand, O AS "O", n_rows FROM r WHERE rk = 1""",
        "random_per_time": f"SELECT case_id, t, arg_min(sample_id, md5('42:' || sample_id::VARCHAR)) AS sample_id FROM samples WHERE {_FIT} GROUP BY 1, 2",
        "group_leaks": "SELECT case_id, count(DISTINCT domain) AS n_domains, count(*) AS n_rows, count(DISTINCT domain) > 1 AS mixed FROM samples JOIN loads ON samples.load_id = loads.load_id WHERE case_id IS NOT NULL GROUP BY 1",
        "common_cases": "SELECT case_id FROM samples WHERE case_id IS NOT NULL INTERSECT SELECT case_id FROM cases",
        "mean_size": """WITH v AS (SELECT result_id, CASE WHEN isfinite(eta) THEN abs(eta) END AS a, CASE WHEN isfinite(eta_mean) THEN abs(eta_mean) END AS b, CASE WHEN isfinite(gamma) THEN abs(gamma) END AS c FROM results),
            m AS (SELECT result_id, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0) AS m FROM v)
            SELECT result_id, floor(m * 1e6 + 0.5) / 1e6 AS mean_size FROM m""",
        "kernel_products": f"""WITH {POINTS}, v AS (SELECT run_id, list(y ORDER BY i) AS v FROM p WHERE i < 9 GROUP BY 1)
            SELECT run_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * v[len(v) + 1 - i])), 6) AS mirrored, round({nine.format(spiral(False))}, 6) AS spiral_left, round({nine.format(spiral(True))}, 6) AS spiral_right FROM v""",
        "coerced_bands": """WITH b AS (SELECT result_id, eta_mean - eta_std AS lo, eta_mean + eta_std AS hi FROM results)
            SELECT result_id, round(CASE WHEN isfinite(lo) AND isfinite(hi) AND hi > lo THEN lo END, 6) AS band_lo, round(CASE WHEN isfinite(lo) AND isfinite(hi) AND hi > lo THEN hi END, 6) AS band_hi FROM b""",
    }
