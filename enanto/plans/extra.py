"""Further registered queries: modes, spectral knees, nulls over places, checks against gates, scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.aggregates import median
from ..functions.scalars import finite, floor_to, round_half_even, safe_div, safe_log, truthy
from ..operators import curve, evaluation, generate, knees, pairing, resampling, spatial
from ..session import table
from . import pipeline, spatial as spatial_plans
from .contrast import HINGE, HINGE_ALL, LINE, PAIRS, POINTS, pairs, points, rounded
from .evaluation import _RUNS, _runs

AGREE = 0.35


def _mode_points(s, d):
    """Log points of two observables of each run in one table; the series is run and mode."""
    r = table(s, d, "results").where("run_id is not null")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("value")) for m in ("eta", "eta_mean")])
    x = r.select("run_id", "L", F.inline(modes)).where(finite(F.col("value")))
    x = x.groupBy(F.concat_ws("|", F.col("run_id").cast("string"), "mode").alias("series"), "L").agg(median(F.col("value")).alias("eta"), F.count("*").alias("n"))
    return curve.log_points(x, "series")


def _mode_candidates(s, d):
    """Knee candidates of each run and mode, at every size with two others on either side, ranked by their gain over the line."""
    k = curve.knee_candidates(_mode_points(s, d), "series", slope_max=8.0, apart=2)
    w = Window.partitionBy("series").orderBy(F.round("delta_bic", 9).desc(), "k")
    parts = F.split("series", "[|]")
    return k.select(parts[0].cast("long").alias("run_id"), parts[1].alias("mode"), "k", "L_k", "delta_bic", "delta_gamma", F.row_number().over(w).alias("rank"))


def _mode_acceptance(s, d):
    """Per run the best candidate of each mode, and whether all modes agree within 35 % of their median size and gain enough."""
    top = _mode_candidates(s, d).where("rank = 1")
    g = top.groupBy("run_id").agg(F.count("*").alias("n_modes"), F.median("L_k").alias("L_mid"), F.min("L_k").alias("lo"), F.max("L_k").alias("hi"), F.min("delta_bic").alias("least_gain"))
    far = F.greatest(F.col("hi") - F.col("L_mid"), F.col("L_mid") - F.col("lo")) / F.greatest(F.col("L_mid"), F.lit(1e-12))
    return g.select("run_id", "n_modes", "L_mid", far.alias("disagreement"), ((F.col("n_modes") == 2) & (far <= AGREE) & (F.col("least_gain") >= 10)).alias("accepted"))


def _spectral_knees(s, d):
    """Knee candidates of each case's power spectrum over frequency."""
    sp = knees.spectra(pipeline._steps(s, d), 32).where("freq > 0")
    p = curve.log_points(sp.select("case_id", F.col("freq").alias("L"), F.col("power").alias("eta"), F.col("n_segments").alias("n")), "case_id")
    return curve.knee_candidates(p, "case_id").select("case_id", "k", "L_k", "delta_bic", "slope_left", "slope_right", "sanity_ok")


def _spectral_knees_full(s, d):
    """The same over segments of up to 128 steps, at every frequency with three others on either side."""
    sp = knees.welch(pipeline._steps(s, d), 128, 24, 16).where("freq > 0 and power > 0")
    p = curve.log_points(sp.select("case_id", F.col("freq").alias("L"), F.col("power").alias("eta"), F.col("n_segments").alias("n")), "case_id").where("n_points >= 10")
    return curve.knee_candidates(p, "case_id", apart=3).select("case_id", "k", "L_k", "delta_bic", "slope_left", "slope_right", "sanity_ok")


def kolmogorov(lam: Column, terms: int = 100) -> Column:
    """Asymptotic p value of a Kolmogorov-Smirnov distance scaled by the root of the effective size."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def _ks_hands(s, d):
    """Left against right readings per domain: exact distance and asymptotic p value."""
    x = pairing.with_domain(pairing.fit_readings(table(s, d, "samples")), table(s, d, "cases"))
    k = evaluation.ks_distance(x, "domain", F.col("O"), F.col("hand") == "L")
    size = F.col("n_first") * F.col("n_second") / (F.col("n_first") + F.col("n_second"))
    return rounded(k.withColumn("p_value", kolmogorov(F.sqrt(size.cast("double")) * F.col("ks"))))


def _spatial_shuffle(s, d):
    """Readings whose O is shuffled over the cases of the same domain, hour of day, size and hand."""
    x = pairing.with_domain(pairing.fit_readings(table(s, d, "samples")), table(s, d, "cases")).select("sample_id", "case_id", "domain", F.hour("t").alias("hour"), "L", "hand", "O")
    x = x.withColumn("k", F.lpad(F.col("sample_id").cast("string"), 20, "0"))
    return resampling.shuffled(x, ["domain", "hour", "L", "hand"], "O", "k").drop("k")


def _fake_mirror(s, d):
    """Pairs whose right side is shuffled over all pairs of the same domain and size."""
    p = pairing.with_domain(pairs(s, d), table(s, d, "cases"))
    x = p.select("case_id", "t", "domain", "L", "O_L", "O_R", resampling.key_of(p).alias("k"))
    y = resampling.shuffled(x, ["domain", "L"], "O_R", "k")
    return y.select("case_id", "t", "domain", "L", "O_L", "O_R")


_GATES = (("power_law", "knee_rate", "<=", 0.10), ("hybrid_knee", "knee_rate", ">=", 0.75), ("forbidden_middle", "middle_rate", ">=", 0.75), ("parity_null", "eta_median", "<=", 0.22))


def _kpi_checks(s, d):
    """Each gate with the measured value of its test and whether it passes."""
    r = _runs(s, d)
    m = r.groupBy("test_name").agg(F.avg(F.col("knee_detected").cast("double")).alias("knee_rate"), F.avg(F.coalesce(F.col("knee_rejected_because").contains("forbidden_middle"), F.lit(False)).cast("double")).alias("middle_rate"))
    e = table(s, d, "results").where(finite(F.col("eta"))).groupBy(F.col("test_name").alias("__t")).agg(median(F.col("eta")).alias("eta_median"))
    x = m.join(e, F.col("test_name") == F.col("__t"))
    gates = F.array(*[F.struct(F.lit(t).alias("gate_test"), F.lit(k).alias("metric"), F.lit(o).alias("op"), F.lit(v).alias("gate")) for t, k, o, v in _GATES])
    x = x.select("test_name", "knee_rate", "middle_rate", "eta_median", F.inline(gates)).where("gate_test = test_name")
    value = F.when(F.col("metric") == "knee_rate", F.col("knee_rate")).when(F.col("metric") == "middle_rate", F.col("middle_rate")).otherwise(F.col("eta_median"))
    return rounded(x.select("test_name", "metric", "op", "gate", value.alias("value"), F.when(F.col("op") == "<=", value <= F.col("gate")).otherwise(value >= F.col("gate")).alias("passed")))


def _regimes(s, d):
    """Regime of each run by rule: middle, knee, null or scaling."""
    r = _runs(s, d)
    regime = F.when(F.coalesce(F.col("knee_rejected_because").contains("forbidden_middle"), F.lit(False)), "middle").when(F.col("knee_detected"), "knee").when(F.abs("gamma") <= 0.1, "null").otherwise("scaling")
    return r.select("run_id", regime.alias("regime"))


def _dashboard(s, d):
    """Per case: pairs, mean contrast, sign consistency, mean of the even and odd parts, and the commonest size."""
    p = pairs(s, d)
    g = p.groupBy("case_id").agg(F.count("*").alias("n_pairs"), F.avg("eta").alias("eta_mean"), F.abs(F.avg(F.signum("signed_parity"))).alias("sign_consistency"), F.avg(F.abs("X_plus")).alias("even_mean"), F.avg(F.abs("X_minus")).alias("odd_mean"))
    n = p.groupBy(F.col("case_id").alias("__c"), "L").agg(F.count("*").alias("c")).groupBy("__c").agg(F.max_by("L", F.struct("c", -F.col("L"))).alias("usual_size"))
    return rounded(g.join(n, F.col("case_id") == F.col("__c")).drop("__c"))


def _gridded(s, d):
    """Per cell and hour: amplitude, odd part as difference of the time gradients, and both sides over centred windows."""
    g = spatial.derived_grid(pairs(s, d), table(s, d, "cases"))
    w = Window.partitionBy("cell").orderBy("time")  # a cell's hours

    def gradient(c: str) -> Column:
        a, b = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(a.isNull(), b - F.col(c)).when(b.isNull(), F.col(c) - a).otherwise((b - a) / 2.0)

    x = g.select("cell", "time", F.sqrt(F.col("u10") * F.col("u10") + F.col("v10") * F.col("v10")).alias("amp"), (gradient("v10") - gradient("u10")).alias("odd"))
    out = None
    for scale in (3, 5, 7):  # a fixed list of scales
        o = w.rowsBetween(-(scale // 2), scale // 2)
        full = F.count("amp").over(o) == scale
        y = x.select("cell", "time", F.lit(scale).alias("scale"), F.when(full, F.avg("amp").over(o)).alias("a"), F.when(full, F.avg("odd").over(o)).alias("o")).where("a is not null and o is not null")
        y = y.select("cell", "time", "scale", (F.col("a") * (1 + 0.35 * F.col("o"))).alias("O_L"), (F.col("a") * (1 - 0.35 * F.col("o"))).alias("O_R"))
        out = y if out is None else out.unionByName(y)
    return rounded(out)


def _scalars(s, d):
    """Bins, guarded arithmetic, calendar parts and strings of each case."""
    c = table(s, d, "cases").where("case_id is not null")
    return rounded(
        c.select(
            "case_id",
            round_half_even(F.col("lat0"), 2.5).alias("lat_bin"),
            floor_to(F.col("lon0"), 10.0).alias("lon_bin"),
            safe_log(F.col("lat0")).alias("log_lat"),
            safe_div(F.col("lon0"), F.col("lat0")).alias("ratio"),
            F.month("onset_time").alias("month"),
            F.hour("onset_time").alias("hour"),
            F.dayofyear("onset_time").alias("day_of_year"),
            F.date_format("onset_time", "yyyyMMddHH").alias("stamp"),
            F.coalesce(F.col("step_s").cast("string"), F.lit("none")).alias("step_label"),
            F.upper(F.trim(F.replace("case_id", F.lit("storm_"), F.lit(" s-")))).alias("short_id"),
            F.coalesce("control_tier", F.lit("unknown")).alias("tier"),
            truthy(F.col("case_type") == "storm").alias("is_storm"),
            F.greatest(F.lit(0.0), F.least(F.col("lat0") + 5, F.lit(30.0)) - F.greatest(F.col("lat0") - 5, F.lit(10.0))).alias("overlap"),
        )
    )


def _noise_models(s, d):
    """The four deviates of each run and size."""
    x = points(s, d)
    key = F.concat_ws("|", F.col("run_id").cast("string"), F.col("i").cast("string"))
    return rounded(x.select("run_id", "i", *[c.alias(n) for n, c in generate.noises(key).items()]))


def _macro_auroc(s, d):
    """One-against-rest area under the curve of each stability class by a score from gamma, and their mean over classes."""
    g = F.col("gamma")
    scores = F.array(*[F.struct(F.lit(c).alias("label"), v.alias("score")) for c, v in (("stable", g), ("forbidden", -g), ("marginal", -F.abs(g)))])
    x = _runs(s, d).where("stability_class is not null").select("stability_class", F.inline(scores)).withColumn("hit", F.col("stability_class") == F.col("label"))
    a = evaluation.auroc(x, "label", "score", "hit")
    return rounded(a.withColumn("macro", F.avg("auroc").over(Window.partitionBy(F.lit(0)))))  # three rows


def _scale_audit(s, d):
    """Per domain: cases, those with at least five sizes, the median number of sizes, and the sizes most cases have."""
    x = pairing.with_domain(pairing.fit_readings(table(s, d, "samples")), table(s, d, "cases"))
    sizes = x.groupBy("domain", "case_id", "L").agg(F.count("*").alias("c"))
    per = sizes.groupBy("domain", "case_id").agg(F.count("*").alias("n")).groupBy("domain").agg(F.count("*").alias("n_cases"), F.count_if(F.col("n") >= 5).alias("n_pass"), median(F.col("n").cast("double")).alias("median_sizes"))
    common = sizes.groupBy(F.col("domain").alias("__d"), "L").agg(F.count("*").alias("k"))
    most = common.groupBy("__d").agg(F.max_by("L", F.struct("k", -F.col("L"))).alias("commonest_size"), F.count("*").alias("n_sizes"))
    return rounded(per.join(most, F.col("domain").eqNullSafe(F.col("__d"))).drop("__d"))


_NO_KNEE, _KNEE = ("power_law", "parity_null"), ("hybrid_knee",)


def _robustness(s, d):
    """By number of sizes of a run (in fives): false positive and negative knee rates, and the 90 % point of its spread.

    Tests without a knee by construction are the negatives, those with one the positives; a rate without a base is null.
    """
    n = table(s, d, "results").where("run_id is not null").groupBy(F.col("run_id").alias("__r")).agg(F.count_distinct("L").alias("n"))
    r = _runs(s, d).join(n, F.col("run_id") == F.col("__r")).withColumn("n_sizes", (F.floor(F.col("n") / 5) * 5).cast("long"))
    no, yes = F.col("test_name").isin(*_NO_KNEE), F.col("test_name").isin(*_KNEE)
    hit = F.col("knee_detected").cast("double")
    g = r.groupBy("n_sizes").agg(F.count("*").alias("n_runs"), F.avg(F.when(no, hit)).alias("fp_rate"), F.avg(F.when(yes, 1.0 - hit)).alias("fn_rate"), F.percentile_approx("spread", 0.9, 1_000_000).alias("spread_p90"))
    return rounded(g)


def queries() -> dict:
    return {
        "macro_auroc": _macro_auroc,
        "scale_audit": _scale_audit,
        "robustness_rates": _robustness,
        "noise_models": _noise_models,
        "coloured_noise": lambda s, d: rounded(generate.coloured_noise(points(s, d), "run_id")),
        "mode_candidates": lambda s, d: rounded(_mode_candidates(s, d)),
        "mode_acceptance": lambda s, d: rounded(_mode_acceptance(s, d)),
        "spectral_knees": lambda s, d: rounded(_spectral_knees(s, d), 4),
        "spectral_knees_full": lambda s, d: rounded(_spectral_knees_full(s, d), 4),
        "ks_hands": _ks_hands,
        "null_spatial_shuffle": _spatial_shuffle,
        "null_fake_mirror": _fake_mirror,
        "kpi_checks": _kpi_checks,
        "regimes": _regimes,
        "confound_dashboard": _dashboard,
        "gridded_sides": _gridded,
        "scalar_functions": _scalars,
    }


def _draw(text: str) -> str:
    return f"('0x' || substr(md5('42:' || {text}), 1, 7))::BIGINT"


def _shuffle(source: str, by: str, value: str, keep: str) -> str:
    same = " AND ".join(f"p.{c} IS NOT DISTINCT FROM q.{c}" for c in by.split(", "))
    return f""", rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:to:' || k), k) AS ra, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || k), k) AS rb FROM {source})
        SELECT {keep}, q.{value} AS "{value}" FROM rk p JOIN rk q ON {same} AND p.ra = q.rb"""


_FIT = "case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND O IS NOT NULL AND isfinite(L) AND isfinite(O) AND hand IN ('L', 'R')"
_MODES = """
md AS (SELECT run_id::VARCHAR || '|eta' AS run_id, L, eta AS v FROM results WHERE run_id IS NOT NULL AND isfinite(eta) UNION ALL SELECT run_id::VARCHAR || '|eta_mean', L, eta_mean FROM results WHERE run_id IS NOT NULL AND isfinite(eta_mean)),
p AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY L) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n_points, L, ln(L) AS x, ln(greatest(abs(eta), 1e-12)) AS y FROM (SELECT run_id, L, median(v) AS eta FROM md GROUP BY 1, 2) WHERE L > 0)"""
_RANKED = f"""{_MODES}{LINE}{HINGE_ALL}, rk AS (SELECT split_part(run_id, '|', 1)::BIGINT AS run_id, split_part(run_id, '|', 2) AS mode, k, L_k, delta_bic, delta_gamma,
  row_number() OVER (PARTITION BY run_id ORDER BY round(delta_bic, 9) DESC, k)::INT AS rank FROM knees)"""


def oracle_sql() -> dict:
    grad = lambda c: f"CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END"
    scales = " UNION ALL ".join(
        f"SELECT cell, time, {k} AS scale, CASE WHEN count(*) OVER w = {k} THEN avg(amp) OVER w END AS a, CASE WHEN count(*) OVER w = {k} THEN avg(odd) OVER w END AS o FROM x WINDOW w AS (PARTITION BY cell ORDER BY time ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING)"
        for k in (3, 5, 7)
    )
    spec = pipeline.oracle_sql()["spectra"]
    spec = spec[: spec.rindex(" SELECT case_id, round(freq")].replace("idx / 8.0", "idx / 16.0").replace("seg * 8", "seg * 16").replace("c = 16", "c = 32").replace("range(9)", "range(17)").replace("IN (0, 8)", "IN (0, 16)").replace("f / 16.0", "f / 32.0")
    spec = spec.replace(repr(2 * math.pi / 16), repr(2 * math.pi / 32)).replace(repr(sum((0.5 - 0.5 * math.cos(2 * math.pi * k / 16)) ** 2 for k in range(16))), repr(sum((0.5 - 0.5 * math.cos(2 * math.pi * k / 32)) ** 2 for k in range(32))))
    tf = ", p AS (SELECT case_id AS run_id, row_number() OVER (PARTITION BY case_id ORDER BY freq) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n_points, freq AS L, ln(freq) AS x, ln(greatest(power, 1e-12)) AS y FROM sp WHERE freq > 0)"
    nu = lambda tag: pipeline._u(tag, "k")
    no = lambda t: f"(sqrt(-2 * ln({nu(t + '1')})) * cos({2 * math.pi!r}::DOUBLE * {nu(t + '2')}))"
    return {
        "macro_auroc": f"""WITH {_RUNS}, x AS (SELECT stability_class, unnest(['stable', 'forbidden', 'marginal']) AS label, unnest([gamma, -gamma, -abs(gamma)]) AS score FROM runs WHERE stability_class IS NOT NULL AND isfinite(gamma)),
            c AS (SELECT label, count(*) FILTER (stability_class = label) AS np, count(*) FILTER (stability_class <> label) AS nn FROM x GROUP BY 1),
            w AS (SELECT a.label, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS wins FROM x a JOIN x b ON a.label = b.label AND a.stability_class = a.label AND b.stability_class <> b.label GROUP BY 1),
            u AS (SELECT c.label, np, nn, wins / nullif(np * nn, 0) AS auc FROM c LEFT JOIN w ON c.label = w.label)
            SELECT label, np AS n_pos, nn AS n_neg, round(auc, 6) AS auroc, round(avg(auc) OVER (), 6) AS macro FROM u""",
        "scale_audit": f"""WITH z AS (SELECT domain, s.case_id, L, count(*) AS c FROM samples s LEFT JOIN cases k ON s.case_id = k.case_id WHERE {_FIT.replace('case_id', 's.case_id')} GROUP BY 1, 2, 3),
            p AS (SELECT domain, case_id, count(*) AS n FROM z GROUP BY 1, 2), m AS (SELECT domain, L, count(*) AS k FROM z GROUP BY 1, 2),
            b AS (SELECT domain, L, count(*) OVER (PARTITION BY domain) AS ns, row_number() OVER (PARTITION BY domain ORDER BY k DESC, L) AS rk FROM m)
            SELECT p.domain, count(*) AS n_cases, count(*) FILTER (n >= 5) AS n_pass, round(median(n), 6) AS median_sizes, round(any_value(b.L), 6) AS commonest_size, any_value(ns) AS n_sizes
            FROM p JOIN b ON p.domain IS NOT DISTINCT FROM b.domain AND rk = 1 GROUP BY p.domain""",
        "robustness_rates": f"""WITH {_RUNS}, n AS (SELECT run_id, count(DISTINCT L) AS n FROM results GROUP BY 1)
            SELECT (n // 5) * 5 AS n_sizes, count(*) AS n_runs, round(avg(CASE WHEN test_name IN ('power_law', 'parity_null') THEN knee_detected::INT END), 6) AS fp_rate,
              round(avg(CASE WHEN test_name = 'hybrid_knee' THEN 1 - knee_detected::INT END), 6) AS fn_rate, round(quantile_disc(spread, 0.9), 6) AS spread_p90 FROM runs JOIN n ON runs.run_id = n.run_id GROUP BY 1""",
        "noise_models": f"""WITH {POINTS}, x AS (SELECT run_id, i, run_id::VARCHAR || '|' || i::VARCHAR AS k FROM p), y AS (SELECT run_id, i, {no('z')} AS z, {no('p')} AS a, {no('q')} AS b, {no('r')} AS c, {nu('l')} - 0.5::DOUBLE AS u FROM x)
            SELECT run_id, i, round(0.02::DOUBLE * z, 6) AS gaussian, round(exp(0.02::DOUBLE * z) - 1, 6) AS lognormal, round(-0.02::DOUBLE / sqrt(2.0::DOUBLE) * sign(u) * ln(1 - 2 * abs(u)), 6) AS laplace,
              round(0.02::DOUBLE * z / sqrt((a * a + b * b + c * c) / 3), 6) AS student_t FROM y""",
        "mode_candidates": f"WITH {_RANKED} SELECT run_id, mode, k, round(L_k, 6) AS \"L_k\", round(delta_bic, 6) AS delta_bic, round(delta_gamma, 6) AS delta_gamma, rank FROM rk",
        "mode_acceptance": f"""WITH {_RANKED}, g AS (SELECT run_id, count(*) AS n, median(L_k) AS m, min(L_k) AS lo, max(L_k) AS hi, min(delta_bic) AS lg FROM rk WHERE rank = 1 GROUP BY 1)
            SELECT run_id, n AS n_modes, round(m, 6) AS "L_mid", round(greatest(hi - m, m - lo) / greatest(m, 1e-12), 6) AS disagreement, n = 2 AND greatest(hi - m, m - lo) / greatest(m, 1e-12) <= {AGREE} AND lg >= 10 AS accepted FROM g""",
        "spectral_knees": spec + tf + LINE + HINGE + " SELECT run_id AS case_id, k, round(L_k, 4) AS \"L_k\", round(delta_bic, 4) AS delta_bic, round(slope_left, 4) AS slope_left, round(slope_right, 4) AS slope_right, reasons = '' AS sanity_ok FROM knees",
        "ks_hands": f"""WITH b AS (SELECT domain, O AS bin, hand = 'L' AS f FROM samples s LEFT JOIN cases c ON s.case_id = c.case_id WHERE {_FIT.replace('case_id', 's.case_id')}),
            k AS (SELECT domain, bin, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM b GROUP BY 1, 2),
            u AS (SELECT domain, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER v AS na, sum(b) OVER v AS nb FROM k WINDOW w AS (PARTITION BY domain ORDER BY bin), v AS (PARTITION BY domain)),
            g AS (SELECT domain, max(na)::BIGINT AS n_first, max(nb)::BIGINT AS n_second, max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))) AS ks FROM u GROUP BY 1),
            l AS (SELECT *, sqrt((n_first * n_second)::DOUBLE / (n_first + n_second)) * ks AS lam FROM g)
            SELECT domain, n_first, n_second, round(ks, 6) AS ks, round(CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * lam * lam))))) END, 6) AS p_value FROM l""",
        "null_spatial_shuffle": f"""WITH x AS (SELECT sample_id, s.case_id, domain, hour(t)::INT AS hour, L, hand, O, lpad(sample_id::VARCHAR, 20, '0') AS k FROM samples s LEFT JOIN cases c ON s.case_id = c.case_id WHERE {_FIT.replace('case_id', 's.case_id')})"""
        + _shuffle("x", "domain, hour, L, hand", "O", 'p.sample_id, p.case_id, p.domain, p.hour, p.L AS "L", p.hand'),
        "null_fake_mirror": f"""WITH {PAIRS}, x AS (SELECT pairs.case_id, t, domain, L, O_L, O_R, pairs.case_id || '|' || epoch_us(t)::VARCHAR || '|' || round(L * 10000)::BIGINT::VARCHAR AS k FROM pairs LEFT JOIN cases c ON pairs.case_id = c.case_id)"""
        + _shuffle("x", "domain, L", "O_R", 'p.case_id, p.t, p.domain, p.L AS "L", p.O_L AS "O_L"'),
        "kpi_checks": f"""WITH {_RUNS}, m AS (SELECT test_name, avg(knee_detected::INT) AS kr, avg(coalesce(contains(knee_rejected_because, 'forbidden_middle'), false)::INT) AS mr FROM runs GROUP BY 1),
            e AS (SELECT test_name, median(eta) AS em FROM results WHERE isfinite(eta) GROUP BY 1),
            g AS (SELECT * FROM (VALUES {', '.join(f"('{t}', '{k}', '{o}', {v}::DOUBLE)" for t, k, o, v in _GATES)}) v(test_name, metric, op, gate)),
            x AS (SELECT g.*, CASE metric WHEN 'knee_rate' THEN kr WHEN 'middle_rate' THEN mr ELSE em END AS value FROM g JOIN m ON g.test_name = m.test_name JOIN e ON g.test_name = e.test_name)
            SELECT test_name, metric, op, gate, round(value, 6) AS "value", CASE WHEN op = '<=' THEN value <= gate ELSE value >= gate END AS passed FROM x""",
        "regimes": f"""WITH {_RUNS} SELECT run_id, CASE WHEN contains(knee_rejected_because, 'forbidden_middle') THEN 'middle' WHEN knee_detected THEN 'knee' WHEN abs(gamma) <= 0.1 THEN 'null' ELSE 'scaling' END AS regime FROM runs""",
        "confound_dashboard": f"""WITH {PAIRS}, n AS (SELECT case_id, L, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, L) AS rk FROM pairs GROUP BY 1, 2)
            SELECT pairs.case_id, count(*) AS n_pairs, round(avg(eta), 6) AS eta_mean, round(abs(avg(sign(signed_parity))), 6) AS sign_consistency, round(avg(abs(X_plus)), 6) AS even_mean, round(avg(abs(X_minus)), 6) AS odd_mean, round(any_value(n.L), 6) AS usual_size
            FROM pairs JOIN n ON pairs.case_id = n.case_id AND rk = 1 GROUP BY 1""",
        "gridded_sides": f"""WITH {spatial_plans._GRID}, x AS (SELECT cell, time, sqrt(u10 * u10 + v10 * v10) AS amp, ({grad('v10')}) - ({grad('u10')}) AS odd FROM grid WINDOW w AS (PARTITION BY cell ORDER BY time)),
            y AS ({scales}) SELECT cell, time, scale, round(a * (1 + 0.35::DOUBLE * o), 6) AS "O_L", round(a * (1 - 0.35::DOUBLE * o), 6) AS "O_R" FROM y WHERE a IS NOT NULL AND o IS NOT NULL""",
        "scalar_functions": """SELECT case_id, round(round_even(lat0 / 2.5, 0) * 2.5, 6) AS lat_bin, round(floor(lon0 / 10) * 10, 6) AS lon_bin, round(CASE WHEN lat0 IS NULL THEN ln(1e-12) ELSE ln(greatest(lat0, 1e-12)) END, 6) AS log_lat,
            round(lon0 / CASE WHEN abs(lat0) < 1e-12 THEN 1e-12 ELSE lat0 END, 6) AS ratio, month(onset_time)::INT AS month, hour(onset_time)::INT AS hour, dayofyear(onset_time)::INT AS day_of_year, strftime(onset_time, '%Y%m%d%H') AS stamp,
            coalesce(step_s::VARCHAR, 'none') AS step_label, upper(trim(replace(case_id, 'storm_', ' s-'))) AS short_id, coalesce(control_tier, 'unknown') AS tier, coalesce(case_type = 'storm', false) AS is_storm,
            round(CASE WHEN lat0 IS NULL THEN 20.0 ELSE greatest(0, least(lat0 + 5, 30) - greatest(lat0 - 5, 10)) END, 6) AS overlap FROM cases WHERE case_id IS NOT NULL""",
    }
