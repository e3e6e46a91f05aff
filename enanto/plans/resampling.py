"""Registered resampling queries, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairing, resampling
from ..session import table
from .contrast import PAIRS, POINTS, pairs, points, rounded, S


def _by_domain(s, d):
    return pairing.with_domain(pairs(s, d), table(s, d, "cases"))


def queries() -> dict:
    fit = lambda f: lambda s, d: rounded(f(points(s, d), S))
    return {
        "null_sign_flip": lambda s, d: resampling.sign_flip(pairs(s, d)),
        "null_mirror_swap": lambda s, d: resampling.mirror_swap(pairing.fit_readings(table(s, d, "samples"))),
        "direction_null": lambda s, d: rounded(resampling.direction_null(_by_domain(s, d), ["domain"])),
        "permutation_null": lambda s, d: rounded(resampling.permutation_null(_by_domain(s, d), ["domain"])),
        "parity_significance": lambda s, d: rounded(resampling.parity_significance(_by_domain(s, d), "domain")),
        "null_time_shuffle": lambda s, d: resampling.time_shuffle(pairing.fit_readings(table(s, d, "samples"))),
        "bootstrap_slopes": fit(resampling.bootstrap_slopes),
        "block_bootstrap": fit(resampling.block_bootstrap),
        "slope_intervals": fit(resampling.slope_intervals),
        "gamma_significance": fit(resampling.gamma_significance),
        "block_means": fit(resampling.block_means),
        "reversed_series": fit(resampling.reversed_series),
        "moving_averages": fit(resampling.moving_averages),
        "zscore_minmax": fit(resampling.scaled),
    }


def _draw(text: str) -> str:
    return f"('0x' || substr(md5('42:' || {text}), 1, 7))::BIGINT"


_KEY = "case_id || '|' || epoch_us(t)::VARCHAR || '|' || round(L * 10000)::BIGINT::VARCHAR"


def oracle_sql() -> dict:
    return {
        "null_sign_flip": f"""WITH {PAIRS}, f AS (SELECT *, {_draw(_KEY)} % 2 = 1 AS flipped FROM pairs)
            SELECT case_id, t, L AS "L", eta, CASE WHEN flipped THEN -signed_parity ELSE signed_parity END AS signed_parity, flipped FROM f""",
        "null_mirror_swap": f"""SELECT sample_id, case_id, t, L AS "L", CASE WHEN {_draw('sample_id::VARCHAR')} % 2 = 1 THEN CASE WHEN hand = 'L' THEN 'R' ELSE 'L' END ELSE hand END AS hand, O AS "O" FROM samples
            WHERE case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND O IS NOT NULL AND isfinite(L) AND isfinite(O) AND hand IN ('L', 'R')""",
        "direction_null": f"""WITH {PAIRS}, x AS (SELECT domain, sign(signed_parity) AS s, pairs.{_KEY} AS k FROM pairs LEFT JOIN cases ON pairs.case_id = cases.case_id),
            m AS (SELECT domain, rep, abs(avg(CASE WHEN {_draw("rep::VARCHAR || ':' || k")} % 2 = 1 THEN -s ELSE s END)) AS m, abs(avg(s)) AS obs FROM x CROSS JOIN (SELECT unnest(range(50)) AS rep) GROUP BY 1, 2)
            SELECT domain, round(max(obs), 6) AS obs_dir, round((count(*) FILTER (round(m, 9) >= round(obs, 9)) + 1) / 51.0::DOUBLE, 6) AS p_dir FROM m GROUP BY 1""",
        "permutation_null": f"""WITH {PAIRS}, x0 AS (SELECT domain, L, O_L, O_R, eta, pairs.{_KEY} AS k FROM pairs LEFT JOIN cases ON pairs.case_id = cases.case_id),
            x AS (SELECT * FROM x0 CROSS JOIN (SELECT unnest(range(10)) AS rep)),
            y AS (SELECT *, row_number() OVER (PARTITION BY domain, L, rep ORDER BY md5('42:to:' || k), k) AS a, row_number() OVER (PARTITION BY domain, L, rep ORDER BY md5('42:' || rep::VARCHAR || ':' || k), k) AS c FROM x),
            z AS (SELECT p.domain, p.rep, median(abs(p.O_L - q.O_R) / greatest((p.O_L + q.O_R) / 2, 1e-12)) AS m FROM y p JOIN y q ON p.domain IS NOT DISTINCT FROM q.domain AND p.L = q.L AND p.rep = q.rep AND p.a = q.c GROUP BY 1, 2),
            o AS (SELECT domain, median(eta) AS ms FROM x0 GROUP BY 1)
            SELECT z.domain, round(ms, 6) AS mirror_stat, round((count(*) FILTER (round(m, 9) >= round(ms, 9)) + 1) / 11.0::DOUBLE, 6) AS p_perm FROM z JOIN o ON z.domain IS NOT DISTINCT FROM o.domain GROUP BY z.domain, ms""",
        "null_time_shuffle": f"""WITH x AS (SELECT sample_id, case_id, t, L, hand, O, lpad(sample_id::VARCHAR, 20, '0') AS k FROM samples
              WHERE case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND O IS NOT NULL AND isfinite(L) AND isfinite(O) AND hand IN ('L', 'R')),
            y AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY md5('42:to:' || k), k) AS a, row_number() OVER (PARTITION BY case_id ORDER BY md5('42:' || k), k) AS c FROM x)
            SELECT p.sample_id, p.case_id, p.t, p.L AS "L", p.hand, q.O AS "O" FROM y p JOIN y q ON p.case_id = q.case_id AND p.a = q.c""",
        "bootstrap_slopes": f"""WITH {POINTS}, x AS (SELECT run_id, rep, {_draw("run_id::VARCHAR || ':' || rep::VARCHAR || ':' || i::VARCHAR")} % n_points AS j FROM p CROSS JOIN (SELECT unnest(range(50)) AS rep)),
            s AS (SELECT x.run_id, rep, CASE WHEN var_pop(p.x) > 0 THEN regr_slope(y, p.x) END AS slope FROM x JOIN p ON x.run_id = p.run_id AND x.j = p.i GROUP BY 1, 2)
            SELECT run_id, count(*) AS n_reps, round(quantile_cont(slope, 0.025), 6) AS lo, round(quantile_cont(slope, 0.975), 6) AS hi FROM s WHERE slope IS NOT NULL GROUP BY 1""",
        "block_bootstrap": f"""WITH {POINTS}, x AS (SELECT run_id, rep, i, n_points, greatest(2, floor(sqrt(n_points))::INT) AS b FROM p CROSS JOIN (SELECT unnest(range(10)) AS rep)),
            y AS (SELECT run_id, rep, least({_draw("run_id::VARCHAR || ':' || rep::VARCHAR || ':' || (i // b)::VARCHAR")} % greatest(1, n_points - b + 1) + i % b, n_points - 1) AS j FROM x)
            SELECT y.run_id, rep::INT AS rep, round(avg(p.y), 6) AS mean_y, count(*) AS n FROM y JOIN p ON y.run_id = p.run_id AND y.j = p.i GROUP BY 1, 2""",
        "reversed_series": f"""WITH {POINTS} SELECT p.run_id, p.i, round(p.y, 6) AS y, round(q.y, 6) AS y_reversed, round(z.y, 6) AS y_rolled FROM p
            JOIN p q ON p.run_id = q.run_id AND q.i = p.n_points - 1 - p.i JOIN p z ON p.run_id = z.run_id AND z.i = (p.i - 1 + p.n_points) % p.n_points""",
        "moving_averages": f"""WITH {POINTS} SELECT run_id, i, round(CASE WHEN count(y) OVER w = 5 THEN avg(y) OVER w END, 6) AS rolling,
            round(avg(y) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS rolling_three, round(sum(y) OVER w / 5, 6) AS convolved
            FROM p WINDOW w AS (PARTITION BY run_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
        "zscore_minmax": f"""WITH {POINTS} SELECT run_id, i, round(CASE WHEN stddev_pop(y) OVER w < 1e-12 THEN 0 ELSE (y - avg(y) OVER w) / stddev_pop(y) OVER w END, 6) AS zscore,
            round(CASE WHEN max(y) OVER w - min(y) OVER w < 1e-12 THEN 0 ELSE (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) END, 6) AS minmax FROM p WINDOW w AS (PARTITION BY run_id)""",
    }
