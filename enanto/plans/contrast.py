"""Registered queries over mirrored pairs and their curves, and SQL that gives the same rows.

Pairs come from ``samples``. The series of every fit is a run of ``results``: as many fits as runs, each over its sizes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregates import median
from ..functions.scalars import finite
from ..operators import curve, pairing
from ..session import table

S = "run_id"


def rounded(df, digits: int = 6):
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes])


def half_up(df, digits: int = 6):
    """Doubles rounded to the nearest decimal, halves up, by floor: the same steps wherever they are taken."""
    one = 10.0**digits
    return df.select(*[(F.floor(F.col(c) * one + 0.5).cast("double") / one).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes])


def pairs(s, d):
    return pairing.pair_table(table(s, d, "samples"))


def points(s, d):
    runs = table(s, d, "results").where(F.col(S).isNotNull() & finite(F.col("eta")))
    return curve.log_points(runs.groupBy(S, "L").agg(median(F.col("eta")).alias("eta"), F.count("*").alias("n")), S)


READINGS = """
r AS (
  SELECT case_id, t, L, hand, arg_min(O, sample_id) AS O, count(*) AS n FROM samples
  WHERE case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND O IS NOT NULL AND isfinite(L) AND isfinite(O) AND hand IN ('L', 'R')
  GROUP BY 1, 2, 3, 4)"""
PAIRS = (
    READINGS
    + """,
pairs AS (
  SELECT a.case_id, a.t, a.L, a.O AS O_L, b.O AS O_R, abs(a.O - b.O) / greatest((a.O + b.O) / 2, 1e-12) AS eta,
         (a.O - b.O) / greatest((a.O + b.O) / 2, 1e-12) AS signed_parity, (a.O + b.O) / 2 AS X_plus, (a.O - b.O) / 2 AS X_minus
  FROM r a JOIN r b ON a.case_id = b.case_id AND a.t = b.t AND a.L = b.L WHERE a.hand = 'L' AND b.hand = 'R')"""
)
POINTS = """
curve AS (SELECT run_id, L, median(eta) AS eta, count(*) AS n FROM results WHERE run_id IS NOT NULL AND isfinite(eta) GROUP BY 1, 2),
p AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY L) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n_points, L, ln(L) AS x,
         ln(greatest(abs(eta), 1e-12)) AS y, n::DOUBLE AS weight
  FROM curve WHERE L > 0)"""
LINE = """,
line AS (
  SELECT run_id, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
         greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x), 0) AS rss
  FROM p GROUP BY 1 HAVING count(*) >= 3 AND var_pop(x) > 0),
lined AS (SELECT *, n * ln(greatest(rss, 1e-12) / n) + 2 * ln(greatest(n, 2)) AS bic FROM line)"""
HINGE = """,
cand AS (
  SELECT run_id, i AS k, L AS L_k, x AS xk FROM p
  WHERE i + 1 >= 3 AND n_points - i - 1 >= 3 AND i + 1 >= 0.2 * n_points AND n_points - i - 1 >= 0.2 * n_points),
uv AS (
  SELECT p.run_id, k, L_k, y, least(x - xk, 0) AS u, greatest(x - xk, 0) AS v FROM p JOIN cand ON p.run_id = cand.run_id),
m AS (
  SELECT run_id, k, L_k, count(*) AS n, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy, var_pop(y) AS yy
  FROM uv GROUP BY 1, 2, 3),
h0 AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS slope_left, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS slope_right FROM m),
h AS (
  SELECT *, greatest(n * (yy - slope_left * uy - slope_right * vy), 0) AS rss FROM h0),
hinge AS (SELECT *, n * ln(greatest(rss, 1e-12) / n) + 3 * ln(greatest(n, 2)) AS bic FROM h),
ends AS (SELECT run_id, min(L) AS lo, max(L) AS hi FROM p GROUP BY 1),
kc AS (
  SELECT hinge.run_id, k, L_k, lined.bic - hinge.bic AS delta_bic, abs(slope_right - slope_left) AS delta_gamma, slope_left, slope_right,
         least(L_k - lo, hi - L_k) / greatest(hi - lo, 1e-12) AS edge_fraction
  FROM hinge JOIN lined ON hinge.run_id = lined.run_id JOIN ends ON hinge.run_id = ends.run_id),
knees AS (
  SELECT *, concat_ws(';', CASE WHEN slope_left IS NULL OR slope_right IS NULL THEN 'slope_non_finite' END,
    CASE WHEN abs(slope_left) > 6 OR abs(slope_right) > 6 THEN 'slope_unphysical' END, CASE WHEN slope_right > 6 THEN 'post_slope_too_flat' END,
    CASE WHEN edge_fraction < 0.15 THEN 'knee_at_edge' END) AS reasons FROM kc)"""


#: The same with every point as candidate that has two others on either side.
HINGE_ALL = HINGE.replace("i + 1 >= 3 AND n_points - i - 1 >= 3 AND i + 1 >= 0.2 * n_points AND n_points - i - 1 >= 0.2 * n_points", "i >= 2 AND n_points - i - 1 >= 2")


def _z(c: str) -> str:
    return f"""CASE WHEN 1.4826 * median(a_{c}) OVER w > 1e-12 THEN ({c} - m_{c}) / (1.4826 * median(a_{c}) OVER w)
      WHEN stddev_pop({c}) OVER w > 1e-12 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END"""


_GRAD = """CASE WHEN lag({y}) OVER w IS NULL THEN (lead({y}) OVER w - {y}) / (lead(x) OVER w - x)
  WHEN lead({y}) OVER w IS NULL THEN ({y} - lag({y}) OVER w) / (x - lag(x) OVER w)
  ELSE ((x - lag(x) OVER w) / (lead(x) OVER w - lag(x) OVER w)) * (lead({y}) OVER w - {y}) / (lead(x) OVER w - x)
     + ((lead(x) OVER w - x) / (lead(x) OVER w - lag(x) OVER w)) * ({y} - lag({y}) OVER w) / (x - lag(x) OVER w) END"""
_BY = "WINDOW w AS (PARTITION BY run_id ORDER BY i)"


def queries() -> dict:
    fit = lambda f: lambda s, d: rounded(f(points(s, d), S))
    return {
        "pair_table": pairs,
        "unpaired_keys": lambda s, d: pairing.unpaired(table(s, d, "samples")),
        "duplicate_keys": lambda s, d: pairing.duplicate_keys(table(s, d, "samples")),
        "pairing_completeness": lambda s, d: rounded(pairing.completeness(table(s, d, "samples"))),
        "parity_energies": lambda s, d: rounded(pairing.parity_energies(pairing.with_domain(pairs(s, d), table(s, d, "cases")), ["domain"])),
        "eta_by_size": lambda s, d: rounded(curve.eta_by_size(pairing.with_domain(pairs(s, d), table(s, d, "cases")), ["domain"])),
        "eta_by_case_size": lambda s, d: rounded(curve.eta_by_size(pairs(s, d), ["case_id"])),
        "log_points": lambda s, d: rounded(points(s, d)),
        "line_bic": fit(curve.line_fits),
        "hinge_candidates": fit(curve.knee_candidates),
        "best_knees": lambda s, d: rounded(curve.best_knees(points(s, d), S)),
        "theil_sen": fit(curve.theil_sen),
        "scaling_fit": fit(curve.weighted_lines),
        "mean_shift": fit(curve.mean_shift),
        "segmented_split": fit(curve.segmented_split),
        "curvature": lambda s, d: rounded(curve.curvature(points(s, d), S).select(S, "i", "L", "d1", "kappa")),
        "curvature_torsion": lambda s, d: rounded(curve.curvature(points(s, d), S).select(S, "i", "torsion"), 3),
        "lag1_autocorrelation": fit(curve.lag1_autocorrelation),
        "instability_band": lambda s, d: rounded(curve.instability_band(points(s, d), S)),
    }


def oracle_sql() -> dict:
    six = lambda *c: ", ".join(f'round({x}, 6) AS "{x}"' for x in c)
    return {
        "pair_table": f"WITH {PAIRS} SELECT case_id, t, L AS \"L\", O_L AS \"O_L\", O_R AS \"O_R\", eta, signed_parity, X_plus AS \"X_plus\", X_minus AS \"X_minus\" FROM pairs",
        "unpaired_keys": f"""WITH {READINGS} SELECT case_id, t, L AS "L", CASE WHEN min(hand) = 'L' THEN 'R' ELSE 'L' END AS missing_hand FROM r GROUP BY case_id, t, L HAVING count(*) = 1""",
        "duplicate_keys": f"""WITH {READINGS} SELECT case_id, t, L AS "L", hand, n AS n_rows FROM r WHERE n > 1""",
        "pairing_completeness": f"""WITH {READINGS}, k AS (SELECT case_id, t, L, count(*) AS c FROM r GROUP BY 1, 2, 3)
            SELECT case_id, count(*) AS n_keys, count(*) FILTER (c = 2) AS n_complete, round(avg((c = 2)::INT), 6) AS completeness FROM k GROUP BY 1""",
        "parity_energies": f"""WITH {PAIRS} SELECT domain, round(avg(X_plus * X_plus), 6) AS "E_plus", round(avg(X_minus * X_minus), 6) AS "E_minus", count(*) AS n_pairs
            FROM pairs LEFT JOIN cases ON pairs.case_id = cases.case_id GROUP BY 1""",
        "eta_by_size": f"""WITH {PAIRS} SELECT domain, round(L, 6) AS "L", round(median(eta), 6) AS eta, round(avg(eta), 6) AS eta_mean, round(coalesce(stddev_samp(eta), 0), 6) AS eta_std,
            round(avg(signed_parity), 6) AS signed_mean, count(*) AS n FROM pairs LEFT JOIN cases ON pairs.case_id = cases.case_id GROUP BY domain, L""",
        "eta_by_case_size": f"""WITH {PAIRS} SELECT case_id, L AS "L", round(median(eta), 6) AS eta, round(avg(eta), 6) AS eta_mean, round(coalesce(stddev_samp(eta), 0), 6) AS eta_std,
            round(avg(signed_parity), 6) AS signed_mean, count(*) AS n FROM pairs GROUP BY case_id, L""",
        "log_points": f"WITH {POINTS} SELECT run_id, i, n_points, {six('L', 'x', 'y', 'weight')} FROM p",
        "line_bic": f"WITH {POINTS}{LINE} SELECT run_id, n, {six('slope', 'intercept', 'rss', 'bic')} FROM lined",
        "hinge_candidates": f"""WITH {POINTS}{LINE}{HINGE} SELECT run_id, k, {six('L_k', 'delta_bic', 'delta_gamma', 'slope_left', 'slope_right', 'edge_fraction')}, reasons, reasons = '' AS sanity_ok FROM knees""",
        "best_knees": f"""WITH {POINTS}{LINE}{HINGE},
            z1 AS (SELECT *, median(delta_bic) OVER w AS m_delta_bic, median(delta_gamma) OVER w AS m_delta_gamma FROM knees WINDOW w AS (PARTITION BY run_id)),
            z2 AS (SELECT *, abs(delta_bic - m_delta_bic) AS a_delta_bic, abs(delta_gamma - m_delta_gamma) AS a_delta_gamma FROM z1),
            z3 AS (SELECT *, {_z('delta_bic')} + {_z('delta_gamma')} AS strength FROM z2 WINDOW w AS (PARTITION BY run_id)),
            z4 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(strength, 9) DESC, k) AS rk FROM z3 WHERE reasons = '' AND delta_bic >= 10 AND strength >= 0.5)
            SELECT run_id, {six('L_k', 'delta_bic', 'delta_gamma', 'strength', 'slope_left', 'slope_right')} FROM z4 WHERE rk = 1""",
        "theil_sen": f"""WITH {POINTS}, s AS (SELECT a.run_id, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.run_id = b.run_id AND a.i < b.i GROUP BY 1),
            q AS (SELECT run_id, count(*) AS n, median(x) AS mx, median(y) AS my FROM p GROUP BY 1)
            SELECT s.run_id, n, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept FROM s JOIN q ON s.run_id = q.run_id WHERE n >= 2""",
        "scaling_fit": f"""WITH {POINTS}, a AS (SELECT run_id, sum(weight) AS sw, sum(weight * x) / sum(weight) AS mx, sum(weight * y) / sum(weight) AS my, count(*) AS n FROM p GROUP BY 1),
            b AS (SELECT p.run_id, sum(weight * (x - mx) * (y - my)) / sum(weight * (x - mx) * (x - mx)) AS g FROM p JOIN a ON p.run_id = a.run_id WHERE n >= 4 GROUP BY 1),
            e AS (SELECT p.run_id, i, n_points, n, g, my - g * mx AS intercept, y - my - g * (x - mx) AS resid FROM p JOIN a ON p.run_id = a.run_id JOIN b ON p.run_id = b.run_id)
            SELECT run_id, max(n) AS n, round(max(g), 6) AS gamma, round(2 - max(g), 6) AS "Delta_hat", round(max(intercept), 6) AS intercept,
              round(abs(avg(resid) FILTER (i < n_points // 2) - avg(resid) FILTER (i >= n_points // 2)), 6) AS drift FROM e GROUP BY 1""",
        "mean_shift": f"""WITH {POINTS}, a AS (SELECT q.run_id, q.i AS split, q.L AS lk,
              abs(avg(p.y) FILTER (p.i >= q.i) - avg(p.y) FILTER (p.i < q.i)) / (stddev_pop(p.y) + 1e-12) AS score
              FROM p q JOIN p ON p.run_id = q.run_id WHERE q.i >= 1 AND q.i < q.n_points - 1 GROUP BY 1, 2, 3),
            b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(score, 9) DESC, split) AS rk FROM a)
            SELECT run_id, split, round(lk, 6) AS "L", round(score, 6) AS score FROM b WHERE rk = 1""",
        "segmented_split": f"""WITH {POINTS}, a AS (SELECT q.run_id, q.i AS split, p.i >= q.i AS late, greatest(regr_syy(p.y, p.x) - coalesce(regr_sxy(p.y, p.x) * regr_slope(p.y, p.x), 0), 0) AS sse
              FROM p q JOIN p ON p.run_id = q.run_id WHERE q.i >= 2 AND q.i < q.n_points - 2 GROUP BY 1, 2, 3),
            b AS (SELECT run_id, split, sum(sse) AS sse FROM a GROUP BY 1, 2),
            c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(sse, 12), split) AS rk FROM b),
            o AS (SELECT run_id, greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x), 0) AS one FROM p GROUP BY 1 HAVING count(*) >= 5)
            SELECT c.run_id, split, round(greatest(0, least(1, 1 - sse / greatest(one, 1e-12))), 6) AS quality FROM c JOIN o ON c.run_id = o.run_id WHERE rk = 1""",
        "curvature": f"""WITH {POINTS}, a AS (SELECT *, {_GRAD.format(y='y')} AS d1 FROM p {_BY}), b AS (SELECT *, {_GRAD.format(y='d1')} AS d2 FROM a {_BY})
            SELECT run_id, i, round(L, 6) AS "L", round(d1, 6) AS d1, round(abs(d2) / pow(1 + d1 * d1, 1.5), 6) AS kappa FROM b""",
        "curvature_torsion": f"""WITH {POINTS}, a AS (SELECT *, {_GRAD.format(y='y')} AS d1 FROM p {_BY}), b AS (SELECT *, {_GRAD.format(y='d1')} AS d2 FROM a {_BY}),
            c AS (SELECT *, abs(d2) / pow(1 + d1 * d1, 1.5) AS kappa FROM b), e AS (SELECT *, {_GRAD.format(y='kappa')} AS torsion FROM c {_BY})
            SELECT run_id, i, round(torsion, 3) AS torsion FROM e""",
        "lag1_autocorrelation": f"""WITH {POINTS}, a AS (SELECT *, lead(y) OVER w AS ny FROM p {_BY})
            SELECT run_id, count(*) AS n, round(CASE WHEN count(*) >= 3 AND sqrt(var_pop(y) FILTER (ny IS NOT NULL) * var_pop(ny)) * (count(*) - 1) > 1e-12 THEN corr(y, ny) ELSE 0 END, 6) AS autocorrelation FROM a GROUP BY 1""",
        "instability_band": f"""WITH {POINTS}, q AS (SELECT * FROM p WHERE n_points >= 6),
            ins AS (SELECT a.run_id, a.i AS c, b.i AS qi, b.x AS qx, b.y AS qy FROM q a JOIN q b ON a.run_id = b.run_id AND abs(a.i - b.i) <= 3),
            sl AS (SELECT a.run_id, a.c, median((b.qy - a.qy) / (b.qx - a.qx)) AS slope FROM ins a JOIN ins b ON a.run_id = b.run_id AND a.c = b.c AND a.qi < b.qi GROUP BY 1, 2),
            md AS (SELECT run_id, c, median(qx) AS mx, median(qy) AS my FROM ins GROUP BY 1, 2 HAVING count(*) >= 4),
            rs AS (SELECT ins.run_id, ins.c, max(slope) AS slope, sqrt(avg(pow(qy - slope * qx - (my - slope * mx), 2))) AS resid
              FROM ins JOIN sl ON ins.run_id = sl.run_id AND ins.c = sl.c JOIN md ON ins.run_id = md.run_id AND ins.c = md.c GROUP BY 1, 2),
            vr AS (SELECT a.run_id, a.c, a.resid, CASE WHEN count(b.slope) >= 2 THEN var_pop(b.slope) END AS v FROM rs a JOIN rs b ON a.run_id = b.run_id AND abs(a.c - b.c) <= 3 GROUP BY 1, 2, 3),
            lm AS (SELECT *, median(v) OVER w AS mv, median(resid) OVER w AS mr FROM vr WINDOW w AS (PARTITION BY run_id)),
            ln_ AS (SELECT *, mv + 2.0 * greatest(1.4826 * median(abs(v - mv)) OVER w, 1e-12) AS lv, mr + 2.0 * greatest(1.4826 * median(abs(resid - mr)) OVER w, 1e-12) AS lr FROM lm WINDOW w AS (PARTITION BY run_id)),
            fl AS (SELECT *, c - row_number() OVER (PARTITION BY run_id ORDER BY c) AS g FROM ln_ WHERE v > lv AND resid > lr),
            ru AS (SELECT run_id, g, min(c) AS a, max(c) AS b FROM fl GROUP BY 1, 2 HAVING max(c) > min(c)),
            be AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY b - a DESC, a) AS rk FROM ru)
            SELECT be.run_id, round(lo.L, 6) AS band_lo, round(hi.L, 6) AS band_hi FROM be JOIN p lo ON be.run_id = lo.run_id AND lo.i = be.a JOIN p hi ON be.run_id = hi.run_id AND hi.i = be.b WHERE rk = 1""",
    }
