"""Registered queries over results, runs and cases, and SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.aggregates import median
from ..functions.scalars import finite
from ..operators import diagnostics, evaluation, parse, pairing
from ..session import table
from . import quality
from .contrast import PAIRS, pairs, rounded

BOUNDARY, BUFFER = "2001-02-15", 3


def _runs(s, d):
    return evaluation.runs(table(s, d, "results"))


def _diagnosed(s, d):
    r = _runs(s, d).select("run_id", "gamma", (F.lit(diagnostics.TWO_PI) / F.col("L_k")).alias("mu"), (F.col("spread") * F.col("L_k")).alias("tau"))
    return rounded(diagnostics.stability_diagnostics(r, "run_id"))


def _stable(s, d):
    return rounded(_runs(s, d).select("run_id", *[c.alias(n) for n, c in diagnostics.stability(F.col("gamma")).items()]))


def _bands(s, d):
    return rounded(diagnostics.predicted_bands(_runs(s, d), "run_id", "L_k"))


def _hits(s, d):
    from pyspark.sql import Window

    curve = table(s, d, "results").where("run_id is not null and L > 0").where(finite(F.col("eta"))).groupBy("run_id", "L").agg(median(F.col("eta")).alias("eta"))
    w = Window.partitionBy("run_id").orderBy("L")
    peak = curve.withColumn("a", F.lag("eta").over(w)).withColumn("b", F.lead("eta").over(w)).where("eta > a and eta > b")
    observed = peak.select("run_id", (F.lit(diagnostics.TWO_PI) / F.col("L")).alias("omega"))
    return rounded(diagnostics.band_hit_rate(diagnostics.predicted_bands(_runs(s, d), "run_id", "L_k"), observed, "run_id"))


def _alignment(s, d):
    x = parse.loaded_rows(table(s, d, "raw_samples"))
    r = diagnostics.alignment_residual(F.col("omega"), F.col("L"))
    return rounded(x.select("line_id", r.alias("residual"), F.abs(r).alias("distance")).where("residual is not null"))


def _impedance(s, d):
    return rounded(diagnostics.impedance(parse.loaded_rows(table(s, d, "raw_samples")), ["load_id"]))


def _middle(s, d):
    r = _runs(s, d)
    share = F.when(F.col("L_k").isNotNull(), F.col("L_k") * 0.4 / F.greatest(F.col("L_max") - F.col("L_min"), F.lit(1e-12)))
    m = diagnostics.middle_scores(F.col("knee_p"), share, 4.0 * F.col("knee_p") - 1.0, F.col("gamma") - 0.5, F.col("spread"), F.lit(1.0))
    return rounded(r.select("run_id", *[c.alias(n) for n, c in m.items()]))


def _ks(s, d):
    p = pairing.pair_table(table(s, d, "samples"))
    kinds = table(s, d, "cases").where("case_id is not null").groupBy(F.col("case_id").alias("__c")).agg(F.min("domain").alias("domain"), F.min("case_type").alias("case_type"))
    return rounded(evaluation.ks_distance(p.join(kinds, F.col("case_id") == F.col("__c")), "domain", F.col("eta"), F.col("case_type") == "storm"))


def _strata(s, d):
    r = table(s, d, "cases")
    t = F.col("case_type")
    labels = F.array_compact(F.array(F.lit("all"), F.when(t.isin("storm", "near_storm"), F.lit("events")), F.when(t == "near_storm", F.lit("near_storm_only")), F.when(t == "control", F.lit("far_nonstorm"))))
    return r.select(F.explode(labels).alias("stratum"), "domain", "step_s").groupBy("stratum", "domain").agg(F.count("*").alias("n_cases"), F.count_distinct("step_s").alias("n_steps"))


def _case_meta(s, d):
    from ..functions.scalars import epoch_micros

    x = table(s, d, "samples").where("case_id is not null")
    g = x.groupBy("case_id").agg(
        F.count("*").alias("n_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_distinct("load_id").alias("n_loads"), F.count_distinct("L").alias("n_sizes"),
        median(epoch_micros(x, "t").cast("double") / 1e6).alias("median_epoch_s"),
    )
    return rounded(g, 3)


def queries() -> dict:
    e = evaluation
    return {
        "stability_class": _stable,
        "stability_diagnostics": _diagnosed,
        "band_prediction": _bands,
        "band_hit_rate": _hits,
        "alignment_residual": _alignment,
        "impedance": _impedance,
        "coherence": lambda s, d: rounded(diagnostics.coherence(pairs(s, d))),
        "middle_scores": _middle,
        "runs": lambda s, d: rounded(_runs(s, d)),
        "case_metrics": lambda s, d: rounded(e.case_metrics(_runs(s, d), ["domain", "test_name"])),
        "reason_counts": lambda s, d: e.reason_counts(_runs(s, d)),
        "top_runs": lambda s, d: e.top_runs(_runs(s, d), "test_name"),
        "confusion": lambda s, d: e.confusion(_runs(s, d)),
        "calibration_error": lambda s, d: rounded(e.calibration_error(_runs(s, d), ["domain"])),
        "auroc": lambda s, d: rounded(e.auroc(_runs(s, d), "domain")),
        "threshold_grid": lambda s, d: rounded(e.threshold_grid(_runs(s, d)).drop("ip", "ig", "im")),
        "best_thresholds": lambda s, d: rounded(e.best_thresholds(_runs(s, d))),
        "error_quantiles": lambda s, d: rounded(e.error_quantiles(table(s, d, "results"), "test_name")),
        "recommended_limits": lambda s, d: rounded(e.recommended_limits(e.error_quantiles(table(s, d, "results"), "test_name"), "test_name")),
        "tail_estimates": lambda s, d: rounded(e.tail_estimates(table(s, d, "results"), "test_name")),
        "ks_storm_control": _ks,
        "strata": _strata,
        "case_meta": _case_meta,
        "blocked_split": lambda s, d: e.blocked_split(table(s, d, "cases"), BOUNDARY, BUFFER),
        "split_gaps": lambda s, d: rounded(e.split_gaps(e.blocked_split(table(s, d, "cases"), BOUNDARY, BUFFER))),
        "stratified_folds": lambda s, d: e.stratified_folds(_runs(s, d), "stability_class", "run_id"),
    }


_RUNS = """
runs AS (
  SELECT run_id, max(domain) AS domain, max(test_name) AS test_name, max(L_k) AS L_k, max(knee_p) AS knee_p, max(knee_detected) AS knee_detected, max(gamma) AS gamma,
    max(stability_class) AS stability_class, max(knee_rejected_because) AS knee_rejected_because, min(L) AS L_min, max(L) AS L_max,
    median(CASE WHEN isfinite(eta_std) THEN eta_std END) AS spread
  FROM results WHERE run_id IS NOT NULL GROUP BY 1)"""
_TP = repr(2.0 * math.pi)
_S = "(pow(2.0, gamma) / sqrt(1 + mu * mu * tau * tau))"
_GRID = f"""
cells AS (SELECT *, (knee_p >= p_min AND gamma >= gamma_min) OR coalesce(spread >= middle_min, false) AS hit FROM runs
  CROSS JOIN (SELECT unnest([0.25, 0.35, 0.45, 0.55]) AS p_min) CROSS JOIN (SELECT unnest([0.0, 0.5, 1.0, 1.5]) AS gamma_min) CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2, 0.4]) AS middle_min)
  WHERE knee_detected IS NOT NULL),
g0 AS (SELECT p_min::DOUBLE AS p_min, gamma_min::DOUBLE AS gamma_min, middle_min::DOUBLE AS middle_min, count(*) FILTER (hit AND knee_detected) AS tp, count(*) FILTER (hit AND NOT knee_detected) AS fp,
  count(*) FILTER (NOT hit AND knee_detected) AS fn, count(*) FILTER (NOT hit AND NOT knee_detected) AS tn FROM cells GROUP BY 1, 2, 3),
g AS (SELECT *, fp / nullif(fp + tn, 0) AS fp_rate, fn / nullif(fn + tp, 0) AS fn_rate, tp / nullif(tp + fp, 0) AS prec, tp / nullif(tp + fn, 0) AS rec,
  coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0) AS f_beta FROM g0)"""
_EQ = """
eq AS (SELECT test_name, count(e) AS n, quantile_disc(e, 0.5) AS p50, quantile_disc(e, 0.9) AS p90, avg((e > 0.2)::INT) AS cat
  FROM (SELECT test_name, CASE WHEN isfinite(eta) AND isfinite(eta_mean) THEN abs(eta - eta_mean) END AS e FROM results) GROUP BY 1)"""


def oracle_sql() -> dict:
    c = quality._CHECKED
    return {
        "stability_class": f"""WITH {_RUNS} SELECT run_id, CASE WHEN gamma > 0.1 THEN 'stable' WHEN gamma < -0.1 THEN 'forbidden' WHEN gamma IS NOT NULL THEN 'marginal' END AS class_hat,
            round(pow(2.0, gamma), 6) AS lambda_eff, gamma > 0.1 AS ineq_pass FROM runs""",
        "stability_diagnostics": f"""WITH {_RUNS}, a AS (SELECT run_id, gamma, {_TP} / L_k AS mu, spread * L_k AS tau FROM runs),
            s AS (SELECT *, CASE WHEN mu > 0 AND tau > 0 THEN {_S} END AS sc FROM a),
            grid AS (SELECT run_id, ln(mu) - ln(20.0) + k * (2 * ln(20.0) / 127) AS lm, gamma, tau FROM a CROSS JOIN (SELECT unnest(range(128)) AS k) WHERE mu > 0 AND tau > 0),
            w AS (SELECT run_id, coalesce(max(lm) - min(lm), 0) AS w FROM (SELECT run_id, CASE WHEN abs(ln(pow(2.0, gamma) / sqrt(1 + exp(lm) * exp(lm) * tau * tau))) <= 0.15 THEN lm END AS lm FROM grid) GROUP BY 1)
            SELECT s.run_id, round(sc, 6) AS "S_at_mu", round(ln(greatest(sc, 1e-12)), 6) AS "S_margin_log",
              CASE WHEN ln(sc) > 0.15 THEN 'coherent' WHEN ln(sc) < -0.15 OR sc IS NULL THEN 'incoherent' ELSE 'forbidden_middle' END AS band_class, round(w, 6) AS "W_mu" FROM s LEFT JOIN w ON s.run_id = w.run_id""",
        "band_prediction": f"WITH {_RUNS} SELECT run_id, n::INT AS n, round(n * {_TP} / L_k, 6) AS omega_pred FROM runs CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) WHERE L_k > 0",
        "band_hit_rate": f"""WITH {_RUNS}, cv AS (SELECT run_id, L, median(eta) AS eta FROM results WHERE run_id IS NOT NULL AND L > 0 AND NOT isnan(eta) GROUP BY 1, 2),
            pk AS (SELECT run_id, {_TP} / L AS omega FROM (SELECT *, lag(eta) OVER w AS a, lead(eta) OVER w AS b FROM cv WINDOW w AS (PARTITION BY run_id ORDER BY L)) WHERE eta > a AND eta > b),
            pr AS (SELECT run_id, n * {_TP} / L_k AS op FROM runs CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) WHERE L_k > 0)
            SELECT run_id, round(avg(EXISTS (SELECT 1 FROM pk WHERE pk.run_id = pr.run_id AND abs(omega - op) / op <= 0.15)::INT), 6) AS hit_rate FROM pr GROUP BY 1""",
        "alignment_residual": c + f"SELECT line_id, round(ln(w_num * l_num / {_TP}), 6) AS residual, round(abs(ln(w_num * l_num / {_TP})), 6) AS distance FROM checked WHERE reason IS NULL AND w_num > 0 AND NOT isinf(w_num)",
        "impedance": c + f"""SELECT load_id, count(w_num) AS n, round(median(w_num * l_num / ({_TP}::DOUBLE * 30)), 6) AS ratio, abs(median(w_num * l_num / ({_TP}::DOUBLE * 30)) - 1) <= 0.1 AS passed
            FROM checked WHERE reason IS NULL GROUP BY 1""",
        "coherence": f"""WITH {PAIRS}, x AS (SELECT *, X_minus - lag(X_minus) OVER (PARTITION BY case_id, L ORDER BY t) AS step, sign(signed_parity) AS s FROM pairs),
            w AS (SELECT case_id, sum(X_plus * X_minus) / (sqrt(sum(X_plus * X_plus)) * sqrt(sum(X_minus * X_minus)) + 1e-12) AS a, exp(-coalesce(stddev_pop(step), 0) / (stddev_pop(X_plus) + 1e-12)) AS f FROM x GROUP BY 1),
            n AS (SELECT * FROM x WHERE s <> 0),
            q AS (SELECT case_id, quantile_cont(L, 0.33) AS q1, quantile_cont(L, 0.66) AS q2, count(DISTINCT L) AS k, avg(s) AS ms FROM n GROUP BY 1),
            sg AS (SELECT n.case_id, max(ms) AS ms, avg(s) AS m FROM n JOIN q ON n.case_id = q.case_id GROUP BY n.case_id, CASE WHEN k < 3 THEN 0 ELSE (L >= q1)::INT + (L >= q2)::INT END),
            lk AS (SELECT case_id, abs(max(ms)) * greatest(0, 1 - coalesce(stddev_pop(m), 0)) AS p FROM sg GROUP BY 1)
            SELECT w.case_id, round(a, 6) AS "A", round(f, 6) AS "F", round(coalesce(greatest(0, least(1, p)), 0), 6) AS "P_lock" FROM w LEFT JOIN lk ON w.case_id = lk.case_id""",
        "middle_scores": f"""WITH {_RUNS}, a AS (SELECT run_id, 1 - abs(2 * greatest(0, least(1, knee_p)) - 1) AS v, greatest(0, least(1, coalesce(L_k * 0.4 / greatest(L_max - L_min, 1e-12), 1))) AS w,
              4 * knee_p - 1 AS st, greatest(0, least(1, abs(gamma - 0.5) / 0.35)) AS b, greatest(0, least(1, greatest(spread, 0) / 0.2)) AS dr FROM runs),
            m AS (SELECT run_id, 0.4 * v + 0.3 * w + 0.2 / (1 + exp(st)) + 0.1 * b AS own, 0.25 * v + 0.25 * w + 0.15 / (1 + exp(st)) + 0.15 * b + 0.1 * dr + 0.05 AS f FROM a)
            SELECT run_id, round(greatest(0, least(1, own)), 6) AS detector_score, round(greatest(0, least(1, f)), 6) AS middle_score, CASE WHEN f >= 0.6 THEN 'forbidden_middle' ELSE 'resolved' END AS middle_label FROM m""",
        "runs": f"""WITH {_RUNS} SELECT run_id, domain, test_name, round(L_k, 6) AS "L_k", round(knee_p, 6) AS knee_p, knee_detected, round(gamma, 6) AS gamma, stability_class, knee_rejected_because,
            round(L_min, 6) AS "L_min", round(L_max, 6) AS "L_max", round(spread, 6) AS spread FROM runs""",
        "case_metrics": f"""WITH {_RUNS} SELECT domain, test_name, count(*) AS n_runs, round(avg(knee_detected::INT), 6) AS knee_rate, round(avg((knee_p >= 0.5)::INT), 6) AS confident_rate,
            round(avg((stability_class = 'stable')::INT), 6) AS stable_rate, count(knee_rejected_because) AS n_rejected, round(median(knee_p), 6) AS knee_p_median, round(median(gamma), 6) AS gamma_median FROM runs GROUP BY 1, 2""",
        "reason_counts": f"WITH {_RUNS}, k AS (SELECT trim(unnest(string_split(knee_rejected_because, ';'))) AS reason FROM runs) SELECT reason, count(*) AS n_runs FROM k WHERE reason <> '' GROUP BY 1",
        "top_runs": f"""WITH {_RUNS} SELECT test_name, run_id, knee_p, gamma, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY test_name ORDER BY knee_p DESC, run_id) AS rank FROM runs) WHERE rank <= 3""",
        "confusion": f"""WITH {_RUNS}, e AS (SELECT CASE WHEN gamma > 0.1 THEN 'stable' WHEN gamma < -0.1 THEN 'forbidden' ELSE 'marginal' END AS expected, stability_class AS reported FROM runs WHERE gamma IS NOT NULL)
            SELECT a.l AS expected, b.l AS reported, count(e.expected) AS n_runs FROM (SELECT unnest(['stable', 'marginal', 'forbidden']) AS l) a CROSS JOIN (SELECT unnest(['stable', 'marginal', 'forbidden']) AS l) b
            LEFT JOIN e ON e.expected = a.l AND e.reported = b.l GROUP BY 1, 2""",
        "calibration_error": f"""WITH {_RUNS}, x AS (SELECT domain, greatest(knee_p, 1 - knee_p) AS conf, ((knee_p >= 0.5) = knee_detected)::INT AS ok FROM runs WHERE knee_p BETWEEN 0 AND 1 AND knee_detected IS NOT NULL),
            b AS (SELECT domain, least(floor(conf * 10), 9) AS b, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM x GROUP BY 1, 2)
            SELECT domain, sum(n)::BIGINT AS n_runs, round(sum(abs(a - c) * n) / sum(n), 6) AS ece FROM b GROUP BY 1""",
        "auroc": f"""WITH {_RUNS}, c AS (SELECT domain, count(*) FILTER (knee_detected) AS np, count(*) FILTER (NOT knee_detected) AS nn FROM runs WHERE isfinite(knee_p) AND knee_detected IS NOT NULL GROUP BY 1),
            w AS (SELECT a.domain, sum(CASE WHEN a.knee_p > b.knee_p THEN 1.0 WHEN a.knee_p = b.knee_p THEN 0.5 ELSE 0 END) AS wins FROM runs a JOIN runs b ON a.domain IS NOT DISTINCT FROM b.domain AND a.knee_detected AND NOT b.knee_detected GROUP BY 1)
            SELECT c.domain, np AS n_pos, nn AS n_neg, round(wins / nullif(np * nn, 0), 6) AS auroc FROM c LEFT JOIN w ON c.domain IS NOT DISTINCT FROM w.domain""",
        "threshold_grid": f"""WITH {_RUNS},{_GRID} SELECT p_min, gamma_min, middle_min, tp, fp, fn, tn, round(fp_rate, 6) AS fp_rate, round(fn_rate, 6) AS fn_rate, round(prec, 6) AS "precision", round(rec, 6) AS recall,
            round(f_beta, 6) AS f_beta, coalesce(fp_rate <= 0.1, true) AS allowed FROM g""",
        "best_thresholds": f"""WITH {_RUNS},{_GRID} SELECT p_min, gamma_min, middle_min, round(fp_rate, 6) AS fp_rate, round(fn_rate, 6) AS fn_rate, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f_beta, 6) AS f_beta
            FROM g WHERE coalesce(fp_rate <= 0.1, true) ORDER BY round(g.f_beta, 12) DESC, p_min, gamma_min, middle_min LIMIT 1""",
        "error_quantiles": f"WITH {_EQ} SELECT test_name, n, round(p50, 6) AS p50, round(p90, 6) AS p90, round(cat, 6) AS catastrophic_rate FROM eq",
        "recommended_limits": f"WITH {_EQ} SELECT test_name, round(p50 * 1.15, 6) AS p50_max, round(p90 * 1.15, 6) AS p90_max, round(least(1, cat * 1.2 + 0.02), 6) AS catastrophic_max FROM eq",
        "tail_estimates": """WITH x AS (SELECT test_name, result_id, eta AS e, abs(eta) AS a FROM results WHERE isfinite(eta)),
            t AS (SELECT *, row_number() OVER (PARTITION BY test_name ORDER BY a DESC, result_id) AS r FROM x WHERE a > 0),
            h AS (SELECT test_name, CASE WHEN count(*) >= 2 AND avg(ln(a)) > ln(min(a)) THEN 1 / (avg(ln(a)) - ln(min(a))) END AS hill FROM t WHERE r <= 32 GROUP BY 1)
            SELECT x.test_name, count(*) AS n, round(CASE WHEN count(*) >= 4 AND var_pop(e) > 1e-12 THEN kurtosis_pop(e) + 3 END, 6) AS kurtosis, round(any_value(hill), 6) AS hill
            FROM x LEFT JOIN h ON x.test_name IS NOT DISTINCT FROM h.test_name GROUP BY x.test_name""",
        "ks_storm_control": f"""WITH {PAIRS}, b AS (SELECT domain, eta AS bin, case_type = 'storm' AS f FROM pairs JOIN cases ON pairs.case_id = cases.case_id WHERE case_type IS NOT NULL),
            k AS (SELECT domain, bin, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM b GROUP BY 1, 2),
            u AS (SELECT domain, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER v AS na, sum(b) OVER v AS nb FROM k WINDOW w AS (PARTITION BY domain ORDER BY bin), v AS (PARTITION BY domain))
            SELECT domain, max(na)::BIGINT AS n_first, max(nb)::BIGINT AS n_second, round(max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))), 6) AS ks FROM u GROUP BY 1""",
        "strata": """WITH x AS (SELECT *, unnest(list_filter(['all', CASE WHEN case_type IN ('storm', 'near_storm') THEN 'events' END, CASE WHEN case_type = 'near_storm' THEN 'near_storm_only' END,
            CASE WHEN case_type = 'control' THEN 'far_nonstorm' END], lambda v: v IS NOT NULL)) AS stratum FROM cases) SELECT stratum, domain, count(*) AS n_cases, count(DISTINCT step_s) AS n_steps FROM x GROUP BY 1, 2""",
        "case_meta": """SELECT case_id, count(*) AS n_rows, min(t) AS first_t, max(t) AS last_t, count(DISTINCT load_id) AS n_loads, count(DISTINCT L) AS n_sizes, round(median(epoch_us(t)::DOUBLE / 1e6), 3) AS median_epoch_s
            FROM samples WHERE case_id IS NOT NULL GROUP BY 1""",
        "blocked_split": f"""SELECT case_id, domain, onset_time, CASE WHEN onset_time < TIMESTAMP '{BOUNDARY}' - INTERVAL {BUFFER} DAY THEN 'train' WHEN onset_time >= TIMESTAMP '{BOUNDARY}' + INTERVAL {BUFFER} DAY THEN 'test' ELSE 'buffer' END AS split
            FROM cases WHERE onset_time IS NOT NULL""",
        "split_gaps": f"""SELECT a.case_id, a.domain, round(min(abs(epoch_us(a.onset_time) - epoch_us(b.onset_time)) / 3.6e9), 6) AS gap_hours FROM cases a
            LEFT JOIN cases b ON a.domain = b.domain AND b.onset_time < TIMESTAMP '{BOUNDARY}' - INTERVAL {BUFFER} DAY WHERE a.onset_time >= TIMESTAMP '{BOUNDARY}' + INTERVAL {BUFFER} DAY GROUP BY 1, 2""",
        "stratified_folds": f"""WITH {_RUNS}, h AS (SELECT run_id, stability_class, md5('42:' || run_id::VARCHAR) AS h FROM runs)
            SELECT run_id, stability_class, ((row_number() OVER (PARTITION BY stability_class, substr(h, 1, 2) ORDER BY h) - 1 + ('0x' || substr(h, 1, 2))::BIGINT) % 5)::INT AS fold FROM h""",
    }
