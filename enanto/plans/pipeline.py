"""Registered queries of the whole pipeline, spectra, generator and sinks, and SQL where it can say the same."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import curve, diagnostics, evaluation, generate, grid, knees, pairing, resampling
from ..session import tables_dir, table, written
from ..streaming import slices
from .contrast import PAIRS, POINTS, S, pairs, points, rounded
from .quality import _P4


def _diagnosed(s, d):
    return rounded(knees.diagnose(points(s, d), S))


def _summary(s, d):
    """One row per run and size, with the run's scalars on each."""
    p = points(s, d)
    k = knees.diagnose(p, S).withColumnRenamed(S, "__run")
    j = p.join(k, F.col(S) == F.col("__run"))
    st = diagnostics.stability(F.col("gamma"))
    return rounded(j.select(S, "i", "L", "x", "y", "n_points", "has_knee", "L_k", "knee_p", "knee_lo", "knee_hi", "delta_bic", "strength", "delta_gamma", "confidence", "reasons", "gamma", (2.0 - F.col("gamma")).alias("Delta_hat"), *[c.alias(n) for n, c in st.items()]))


def _scalings(s, d):
    """Scaling of each run outside the unstable band its knee diagnosis gives, with 2,000 resamples."""
    p = points(s, d)
    k = knees.diagnose(p, S).select(F.col(S).alias("__run"), F.when(F.col("has_knee") | F.col("band_found"), F.col("band_lo")).alias("band_lo"), F.when(F.col("has_knee") | F.col("band_found"), F.col("band_hi")).alias("band_hi"))
    return rounded(knees.scalings(p.join(k, F.col(S) == F.col("__run")).drop("__run"), S))


def _null_gamma(s, d):
    """Observed log-log slope of each run against slopes over sizes shuffled within the run."""
    return rounded(resampling.null_slopes(points(s, d), S))


def c_range(s, d):
    """Possible range of O per case."""
    b = table(s, d, "domains").select(F.col("domain").alias("__d"), "o_min", "o_max")
    return table(s, d, "cases").join(b, F.col("domain") == F.col("__d")).groupBy(F.col("case_id").alias("__k")).agg(F.min("o_min").alias("o_min"), F.max("o_max").alias("o_max"))


def _steps(s, d):
    c = table(s, d, "cases").where("case_id is not null and step_s > 0").groupBy(F.col("case_id").alias("__c")).agg(F.min("step_s").cast("long").alias("step_s"))
    # Readings outside the possible range would drown every spectrum.
    known = c_range(s, d)
    fair = table(s, d, "samples").join(known, F.col("case_id") == F.col("__k")).where("O between o_min and o_max")
    g = grid.regular_grid(fair.drop("__k", "o_min", "o_max"), table(s, d, "cases"))
    return g.join(c, F.col("case_id") == F.col("__c")).drop("__c")


def _partitioned(s, d):
    """Samples written in directories by domain and day, then counted from what was written."""
    x = pairing.with_domain(pairing.fit_readings(table(s, d, "samples")), table(s, d, "cases"))
    x = x.select("sample_id", "O", F.coalesce("domain", F.lit("none")).alias("domain"), F.to_date("t").cast("string").alias("day"))
    path = f"{tables_dir(s)}/partitioned-{uuid.uuid4().hex}"
    x.repartition("domain", "day").write.mode("overwrite").partitionBy("domain", "day").parquet(path)
    back = s.read.schema("sample_id bigint, O double, domain string, day string").parquet(path)
    return back.groupBy("domain", "day").agg(F.count("*").alias("n_rows"))


def _models(s, d):
    keys = pairing.fit_readings(table(s, d, "samples")).where("L > 0").select("case_id", "L").distinct()
    return generate.modelled(keys)


def _validation(s, d):
    """One row of counts that decide whether a samples table is valid."""
    x = table(s, d, "samples")
    keys = x.groupBy("case_id", "t", "L").agg(F.count_distinct("hand").alias("h"))
    k = keys.agg(F.count("*").alias("n_keys"), F.count_if(F.col("h") == 2).alias("n_complete"))
    a = x.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("hand").isNotNull() & ~F.col("hand").isin("L", "R")).alias("n_bad_hand"),
        F.count_if(F.col("L").isNull() | F.isnan("L") | (F.abs("L") == float("inf"))).alias("n_bad_size"), F.count_if(F.col("O").isNull() | F.isnan("O")).alias("n_no_observable"),
    )
    j = a.withColumn("one", F.lit(1)).join(k.withColumn("__one", F.lit(1)), F.col("one") == F.col("__one")).drop("one", "__one")  # one row each
    return rounded(j.withColumn("completeness", F.try_divide("n_complete", "n_keys")))


def _audit(s, d):
    """Decision of each run with the reasons for it."""
    r = evaluation.runs(table(s, d, "results"))
    ok = F.col("knee_detected") & (F.col("stability_class") == "stable")
    why = F.concat_ws(";", F.when(~F.col("knee_detected"), F.coalesce("knee_rejected_because", F.lit("no_knee"))), F.when(F.col("stability_class") != "stable", F.concat(F.lit("class_"), "stability_class")), F.when(F.col("knee_p") < 0.35, F.lit("knee_p_low")))
    return r.select("run_id", F.when(ok, "accept").otherwise("reject").alias("decision"), why.alias("why"))


def _classifier(s, d):
    from ..operators import classify

    return rounded(classify.out_of_fold(evaluation.runs(table(s, d, "results")), "stability_class", "run_id", ["L_min", "L_max", "knee_p", "gamma", "spread"]))


def queries() -> dict:
    return {
        "knee_diagnosis": _diagnosed,
        "run_summary": _summary,
        "scaling_intervals": _scalings,
        "null_gamma": _null_gamma,
        "spectra": lambda s, d: rounded(knees.spectra(_steps(s, d), 16)),
        "ticks": lambda s, d: rounded(knees.ticks(knees.spectra(_steps(s, d), 16))),
        "spectra_full": lambda s, d: rounded(knees.welch(_steps(s, d))),
        "ticks_full": lambda s, d: rounded(knees.ticks(knees.welch(_steps(s, d)))),
        "phase_scrambled": lambda s, d: rounded(knees.phase_scrambled(points(s, d), S)),
        "eta_models": lambda s, d: rounded(_models(s, d)),
        "synthetic_pairs": lambda s, d: rounded(generate.synthetic_pairs(_models(s, d))),
        "stressed_pairs": lambda s, d: rounded(generate.stressed(pairs(s, d))),
        "partition_counts": _partitioned,
        "validation_counts": _validation,
        "run_audit": _audit,
        "class_predictions": _classifier,
        "stream_slices": lambda s, d: slices.slice_counts(s, f"{d}/samples.parquet"),
        "stream_hourly": lambda s, d: slices.hourly(s, f"{d}/samples.parquet"),
    }


def _draw(text: str) -> str:
    return f"('0x' || substr(md5('42:' || {text}), 1, 7))::BIGINT"


def _u(tag: str, key: str) -> str:
    return f"((" + _draw(f"'{tag}:' || {key}") + f" + 0.5::DOUBLE) / {int(16**7)})"


_MODELS = f"""
keys AS (SELECT DISTINCT case_id, L, case_id || '|' || round(L * 10000)::BIGINT::VARCHAR AS k FROM samples
  WHERE case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND O IS NOT NULL AND isfinite(L) AND isfinite(O) AND hand IN ('L', 'R') AND L > 0),
models AS (
  SELECT case_id, L, 'power_law' AS model, 0.01::DOUBLE * L AS eta FROM keys
  UNION ALL SELECT case_id, L, 'hybrid_knee', CASE WHEN L <= 40 THEN 0.01::DOUBLE * L ELSE 0.4::DOUBLE * exp(-pow((L - 40) / 20, 2)) END FROM keys
  UNION ALL SELECT case_id, L, 'piecewise_forbidden', CASE WHEN L < 30 THEN 0.01::DOUBLE * pow(L, 1.6) WHEN L > 70 THEN 0.01::DOUBLE * pow(30, 1.6) * pow(L / 70, 0.7)
    ELSE 0.01::DOUBLE * pow(30, 1.6) * pow(L / 30, 0.2::DOUBLE + 1.9::DOUBLE * {_u('slope', 'k')}) * exp(0.35::DOUBLE * ({_u('a', 'k')} + {_u('b', 'k')} + {_u('c', 'k')} - 1.5::DOUBLE) * 2) END FROM keys
  UNION ALL SELECT case_id, L, 'eigen_stability', 0.01::DOUBLE * pow(L, ([-0.5, 0.2, 1.0, 1.8]::DOUBLE[])[{_draw("'run:' || k")} % 4 + 1]) FROM keys
  UNION ALL SELECT case_id, L, 'dual_hybrid_knee', 0.01::DOUBLE * pow(L, 1.4) * exp(-pow(L / 24, 2)) + 0.008::DOUBLE * L * exp(-pow(L / 70, 2)) FROM keys
  UNION ALL SELECT case_id, L, 'screened_power_law', 0.02::DOUBLE * L * exp(-pow(L / 30, 2.5)) FROM keys
  UNION ALL SELECT case_id, L, 'logistic_curve', 0.01::DOUBLE + 0.34::DOUBLE / (1 + exp(-(L - 40) / 8)) FROM keys)"""


def oracle_sql() -> dict:
    mk = "case_id || '|' || round(L * 10000)::BIGINT::VARCHAR || '|' || model"
    lap = lambda side: f"(-0.02::DOUBLE / sqrt(2.0::DOUBLE) * sign({_u(side, 'k')} - 0.5::DOUBLE) * ln(1 - 2 * abs({_u(side, 'k')} - 0.5::DOUBLE)))"
    hop, seg = 8, 16
    norm = repr(sum((0.5 - 0.5 * math.cos(2 * math.pi * k / seg)) ** 2 for k in range(seg)))
    step = repr(2 * math.pi / seg)
    fair = "FROM samples s JOIN (SELECT case_id AS ck, min(o_min) AS lo, max(o_max) AS hi FROM cases JOIN domains ON cases.domain = domains.domain GROUP BY 1) b ON s.case_id = ck AND O BETWEEN lo AND hi JOIN"
    spec = _P4.replace("FROM samples s JOIN", fair) + f""",
gr AS (SELECT case_id, g // step_s AS idx, CASE WHEN g = slot_s THEN o ELSE o + (n_o - o) * ((g - slot_s) + step_s / 2.0 - into_us / 1e6) / ((n_slot - slot_s) + n_into / 1e6 - into_us / 1e6) END AS v FROM g),
sg AS (SELECT case_id, v, unnest([floor(idx / {hop}.0)::BIGINT, floor(idx / {hop}.0)::BIGINT - 1]) AS seg, idx FROM gr),
ct AS (SELECT *, idx - seg * {hop} AS k, avg(v) OVER (PARTITION BY case_id, seg) AS m, count(*) OVER (PARTITION BY case_id, seg) AS c FROM sg),
wd AS (SELECT case_id, seg, k, (v - m) * (0.5::DOUBLE - 0.5::DOUBLE * cos(k * {step}::DOUBLE)) AS w FROM ct WHERE c = {seg}),
ft AS (SELECT case_id, seg, f, pow(sum(w * cos(k * f * {step}::DOUBLE)), 2) + pow(sum(w * sin(k * f * {step}::DOUBLE)), 2) AS p FROM wd CROSS JOIN (SELECT unnest(range({hop + 1})) AS f) GROUP BY 1, 2, 3),
sp AS (SELECT case_id, f / {seg}.0::DOUBLE AS freq, avg(p) * CASE WHEN f IN (0, {hop}) THEN 1 ELSE 2 END / {norm}::DOUBLE AS power, count(*) AS n_segments FROM ft GROUP BY case_id, f)"""
    g = "(exp(0.25::DOUBLE * (hour(t) * 3600 + minute(t) * 60 + second(t)) / 86400) * (1 + greatest(0, 0.6::DOUBLE / (1 + exp(-(L - 40) / 20)))))"
    key = "case_id || '|' || epoch_us(t)::VARCHAR || '|' || round(L * 10000)::BIGINT::VARCHAR"
    return {
        "null_gamma": f"""WITH {POINTS}, x AS (SELECT run_id, i, x, y, rep, run_id::VARCHAR || ':' || lpad(i::VARCHAR, 6, '0') AS k FROM p CROSS JOIN (SELECT unnest(range(20)) AS rep)),
            z AS (SELECT *, row_number() OVER (PARTITION BY run_id, rep ORDER BY md5('42:to:' || k), k) AS a, row_number() OVER (PARTITION BY run_id, rep ORDER BY md5('42:' || rep::VARCHAR || ':' || k)) AS c FROM x),
            g AS (SELECT a.run_id, a.rep, regr_slope(b.y, a.x) AS g FROM z a JOIN z b ON a.run_id = b.run_id AND a.rep = b.rep AND a.a = b.c GROUP BY 1, 2),
            o AS (SELECT run_id, regr_slope(y, x) AS gamma FROM p GROUP BY 1)
            SELECT g.run_id, round(gamma, 6) AS gamma, round(avg(g), 6) AS null_mean, round((count(*) FILTER (abs(round(g, 9)) >= abs(round(gamma, 9))) + 1) / 21.0::DOUBLE, 6) AS p_value FROM g JOIN o ON g.run_id = o.run_id GROUP BY 1, gamma""",
        "spectra": spec + " SELECT case_id, round(freq, 6) AS freq, round(power, 6) AS power, n_segments FROM sp",
        "ticks": spec + """, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(power, 12) DESC, freq) AS r FROM sp WHERE freq > 0),
            t AS (SELECT case_id, round(2 * pi() * freq, 9) AS w FROM r WHERE r <= 3)
            SELECT r.case_id, any_value(l.o) AS omegas, round(max(power) / sum(power), 6) AS "R_Omega", round(max(power) / median(power), 6) AS ridge_strength,
              round(0.9::DOUBLE * max(2 * pi() * freq) FILTER (r = 1), 6) AS band_lo, round(1.1::DOUBLE * max(2 * pi() * freq) FILTER (r = 1), 6) AS band_hi
            FROM r JOIN (SELECT case_id, string_agg(w::VARCHAR, '|' ORDER BY w) AS o FROM t GROUP BY 1) l ON r.case_id = l.case_id GROUP BY 1""",
        "eta_models": f"WITH {_MODELS} SELECT case_id, round(L, 6) AS \"L\", model, round(eta, 6) AS eta FROM models",
        "synthetic_pairs": f"""WITH {_MODELS}, x AS (SELECT *, {mk} AS k, CASE WHEN {_draw("'sign:' || case_id")} % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM models),
            y AS (SELECT *, greatest(1e-8, (1 + sg * eta / 2) * (1 + {lap('L')})) AS l_, greatest(1e-8, (1 - sg * eta / 2) * (1 + {lap('R')})) AS r_, {_u('swap', 'k')} < 0.5 AS swapped FROM x)
            SELECT case_id, round(L, 6) AS "L", model, round(eta, 6) AS eta, round(CASE WHEN swapped THEN r_ ELSE l_ END, 6) AS "O_L", round(CASE WHEN swapped THEN l_ ELSE r_ END, 6) AS "O_R", swapped FROM y""",
        "stressed_pairs": f"""WITH {PAIRS}, x AS (SELECT case_id, date_trunc('hour', t)::TIMESTAMP AS t, L, greatest(1e-8, O_L * {g}) AS a, greatest(1e-8, O_R * {g}) AS b FROM pairs WHERE {_u('lost', '(' + key + ')')} >= 0.03)
            SELECT case_id, t, round(L, 6) AS "L", round(CASE WHEN L > 40 THEN b ELSE a END, 6) AS "O_L", round(CASE WHEN L > 40 THEN a ELSE b END, 6) AS "O_R" FROM x""",
        "partition_counts": """SELECT coalesce(domain, 'none') AS domain, t::DATE::VARCHAR AS day, count(*) AS n_rows FROM samples s LEFT JOIN cases c ON s.case_id = c.case_id
            WHERE s.case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND O IS NOT NULL AND isfinite(L) AND isfinite(O) AND hand IN ('L', 'R') GROUP BY 1, 2""",
        "validation_counts": """WITH k AS (SELECT count(DISTINCT hand) AS h FROM samples GROUP BY case_id, t, L)
            SELECT (SELECT count(*) FROM samples) AS n_rows, (SELECT count(*) FROM samples WHERE hand NOT IN ('L', 'R')) AS n_bad_hand, (SELECT count(*) FROM samples WHERE L IS NULL OR NOT isfinite(L)) AS n_bad_size,
              (SELECT count(*) FROM samples WHERE O IS NULL OR isnan(O)) AS n_no_observable, count(*) AS n_keys, count(*) FILTER (h = 2) AS n_complete, round(avg((h = 2)::INT), 6) AS completeness FROM k""",
        "run_audit": """WITH r AS (SELECT run_id, max(knee_detected) AS kd, max(stability_class) AS sc, max(knee_p) AS kp, max(knee_rejected_because) AS kr FROM results WHERE run_id IS NOT NULL GROUP BY 1)
            SELECT run_id, CASE WHEN kd AND sc = 'stable' THEN 'accept' ELSE 'reject' END AS decision,
              concat_ws(';', CASE WHEN NOT kd THEN coalesce(kr, 'no_knee') END, CASE WHEN sc <> 'stable' THEN 'class_' || sc END, CASE WHEN kp < 0.35 THEN 'knee_p_low' END) AS why FROM r""",
        "stream_slices": """WITH x AS (SELECT DISTINCT case_id, t, L, hand FROM samples WHERE case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND NOT isnan(L) AND hand IN ('L', 'R'))
            SELECT case_id, t, count(*) AS n_seen FROM x WHERE t <= (SELECT max(t) FROM x) - INTERVAL 1 HOUR GROUP BY 1, 2""",
        "stream_hourly": """WITH x AS (SELECT * FROM samples WHERE t IS NOT NULL AND hand IN ('L', 'R'))
            SELECT * FROM (SELECT date_trunc('hour', t)::TIMESTAMP AS hour, hand, count(*) AS n_rows, count(O) AS n_readings FROM x GROUP BY 1, 2)
            WHERE hour + INTERVAL 1 HOUR <= (SELECT max(t) FROM x) - INTERVAL 1 HOUR""",
    }
