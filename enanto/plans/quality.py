"""Registered queries of problems 1 to 4, and SQL that gives the same rows."""

from __future__ import annotations

from ..operators import grid, parse, profile, spikes
from ..session import table

_LINE = r'(?s)(?:,(?:"(?:[^"]|"")*"|[^",]*))*'
_NUM = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_T = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?Z?"

_CHECKED = f"""
WITH cut AS (
  SELECT *, regexp_full_match(',' || coalesce(raw_line, ''), '{_LINE}') AS quoted,
         regexp_extract_all(',' || coalesce(raw_line, ''), '(?s),("(?:[^"]|"")*"|[^",]*)', 1) AS raw_f
  FROM raw_samples),
f AS (
  SELECT *, len(raw_f) AS k,
         list_transform(raw_f, lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, greatest(length(x) - 2, 0)), '""', '"') ELSE x END, ' ')) AS v
  FROM cut),
n AS (
  SELECT *,
         CASE WHEN regexp_full_match(v[3], '{_NUM}') THEN try_cast(v[3] AS DOUBLE) END AS l_num,
         CASE WHEN regexp_full_match(v[5], '{_NUM}') THEN try_cast(v[5] AS DOUBLE) END AS o_num,
         CASE WHEN regexp_full_match(v[6], '{_NUM}') THEN try_cast(v[6] AS DOUBLE) END AS w_num
  FROM f),
checked AS (
  SELECT *, CASE
    WHEN NOT quoted THEN 'quoting'
    WHEN k <> 7 THEN 'column_count'
    WHEN NOT regexp_full_match(v[1], '[a-z]+_[0-9]+') THEN 'case_id'
    WHEN NOT regexp_full_match(v[2], '{_T}') OR try_cast(substr(v[2], 1, 10) AS DATE) IS NULL OR v[2] LIKE '0000%' THEN 't'
    WHEN l_num IS NULL OR isinf(l_num) OR l_num <= 0 THEN 'L'
    WHEN v[4] NOT IN ('L', 'R') THEN 'hand'
    WHEN v[5] <> '' AND (o_num IS NULL OR isinf(o_num)) THEN 'O' END AS reason
  FROM n)
"""

_P4 = """
WITH used AS (
  SELECT s.case_id, min_step AS step_s, epoch_us(t) AS us, O AS o
  FROM samples s JOIN (SELECT case_id, min(step_s)::BIGINT AS min_step FROM cases WHERE step_s > 0 GROUP BY case_id) c ON s.case_id = c.case_id
  WHERE t IS NOT NULL AND O IS NOT NULL AND isfinite(O)),
slots AS (
  SELECT case_id, step_s, CAST(floor(us / (step_s * 1000000.0)) AS BIGINT) * step_s AS slot_s, count(*) AS n_readings,
         avg(us - CAST(floor(us / (step_s * 1000000.0)) AS BIGINT) * step_s * 1000000) AS into_us, avg(o) AS o
  FROM used GROUP BY 1, 2, 3),
nb AS (
  SELECT *, lead(slot_s) OVER w AS n_slot, lead(into_us) OVER w AS n_into, lead(o) OVER w AS n_o
  FROM slots WINDOW w AS (PARTITION BY case_id ORDER BY slot_s)),
g AS (
  SELECT *, coalesce(n_slot - slot_s <= 96 * step_s, false) AS near,
         unnest(range(slot_s, CASE WHEN n_slot - slot_s <= 96 * step_s THEN n_slot ELSE slot_s + 1 END, step_s)) AS g
  FROM nb)
"""


_KEY = "case_id, L, hand"
_NONE = "'-infinity'::DOUBLE"


def _spike_sql() -> str:
    """The rule itself, over whole series and without the candidates' screen."""

    def frame(a: str, b: str) -> str:
        return f"(PARTITION BY {_KEY} ORDER BY t ROWS BETWEEN {a} AND {b})"

    sides, devs = [], []
    for w in (1, 2, 3):
        ahead, run = frame(f"{w} FOLLOWING", f"{w + 4} FOLLOWING"), frame("CURRENT ROW", f"{w - 1} FOLLOWING")
        sides.append(
            f"median(o) OVER {ahead} AS a{w}, count(o) OVER {ahead} AS na{w}, min(o) OVER {run} AS mn{w}, max(o) OVER {run} AS mx{w}, max(stuck::INT) OVER {run} AS st{w}, lead(o, {w}) OVER (PARTITION BY {_KEY} ORDER BY t) AS nx{w}"
        )
        up, down = f"(mn{w} - greatest(b, a{w}))", f"(least(b, a{w}) - mx{w})"
        devs.append(
            f"CASE WHEN nb >= 3 AND na{w} >= 3 AND st{w} = 0 THEN greatest(CASE WHEN greatest(pv, nx{w}) - greatest(b, a{w}) > 0.5 * {up} THEN {_NONE} ELSE {up} END, CASE WHEN least(b, a{w}) - least(pv, nx{w}) > 0.5 * {down} THEN {_NONE} ELSE {down} END) ELSE {_NONE} END AS d{w}"
        )
    whole = ", ".join(f"max(d{w}) OVER {frame(f'{w - 1} PRECEDING', 'CURRENT ROW')}" for w in (1, 2, 3))
    return f"""
WITH e AS (
  SELECT sample_id, s.case_id, t, L, hand, O AS o, coalesce(O < o_min OR O > o_max, false) OR isinf(O) AS impossible
  FROM samples s LEFT JOIN cases c ON s.case_id = c.case_id LEFT JOIN domains d ON c.domain = d.domain
  WHERE s.case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND NOT isnan(L) AND O IS NOT NULL AND NOT isnan(O) AND hand IN ('L', 'R')),
r AS (SELECT {_KEY}, t, arg_min(o, sample_id) AS o FROM e WHERE NOT impossible GROUP BY {_KEY}, t),
g AS (SELECT *, (o IS DISTINCT FROM lag(o) OVER (PARTITION BY {_KEY} ORDER BY t))::INT AS chg FROM r),
h AS (SELECT *, sum(chg) OVER (PARTITION BY {_KEY} ORDER BY t) AS run FROM g),
k AS (SELECT *, count(*) OVER (PARTITION BY {_KEY}, run) >= 10 AS stuck, count(*) OVER (PARTITION BY {_KEY}) AS n, median(o) OVER {frame('3 PRECEDING', '3 FOLLOWING')} AS lev FROM h),
c AS (SELECT {_KEY}, 1.4826 * median(abs(o - lev)) FILTER (NOT stuck) AS scatter FROM k GROUP BY {_KEY}),
x AS (SELECT *, lag(o) OVER (PARTITION BY {_KEY} ORDER BY t) AS pv, median(o) OVER {frame('5 PRECEDING', '1 PRECEDING')} AS b, count(o) OVER {frame('5 PRECEDING', '1 PRECEDING')} AS nb, {', '.join(sides)} FROM k),
y AS (SELECT {_KEY}, t, o, n, stuck, {', '.join(devs)} FROM x),
z AS (SELECT *, greatest({whole}) AS dev FROM y),
f AS (SELECT z.case_id, z.L, z.hand, t, CASE WHEN stuck THEN 'stuck' ELSE 'spike' END AS kind FROM z JOIN c ON z.case_id = c.case_id AND z.L = c.L AND z.hand = c.hand WHERE stuck OR (n >= 40 AND dev > 12 * scatter))
SELECT sample_id, 'impossible' AS kind FROM e WHERE impossible
UNION ALL SELECT sample_id, kind FROM e JOIN f ON e.case_id = f.case_id AND e.L = f.L AND e.hand = f.hand AND e.t = f.t WHERE NOT impossible"""


_STEPS = """
WITH y AS (SELECT a.load_id, l.domain, 'L' AS column_name, L AS v, CASE WHEN isfinite(L) THEN L END AS x FROM samples a LEFT JOIN loads l ON a.load_id = l.load_id
  UNION ALL SELECT a.load_id, l.domain, 'O', O, CASE WHEN isfinite(O) AND NOT coalesce(O < o_min OR O > o_max, false) THEN O END FROM samples a LEFT JOIN loads l ON a.load_id = l.load_id LEFT JOIN domains d ON l.domain = d.domain),
e AS (SELECT domain, column_name, coalesce((min(x) + max(x)) / 2, 0) AS c, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 2147483648 ELSE 1 END AS u FROM y GROUP BY 1, 2),
q AS (SELECT y.*, c, u, round_even((x - c) / u, 0)::HUGEINT AS q FROM y JOIN e ON y.domain IS NOT DISTINCT FROM e.domain AND y.column_name = e.column_name),
z AS (SELECT load_id, domain, column_name, any_value(c) AS c, any_value(u) AS u, count(*) AS n_rows, count(*) FILTER (v IS NULL OR isnan(v)) AS n_missing, count(*) FILTER (v IS NOT NULL AND NOT isnan(v) AND x IS NULL) AS n_violations,
  count(DISTINCT v) AS n_distinct, count(q)::DOUBLE AS s0, sum(q) AS e1, sum(q * q) AS e2, sum(q)::DOUBLE AS s1, sum(q * q)::DOUBLE AS s2,
  sum(((q * q) // 1073741824) * q)::DOUBLE * 1073741824 + sum(((q * q) % 1073741824) * q)::DOUBLE AS s3,
  sum(((q * q) // 1073741824) * ((q * q) // 1073741824))::DOUBLE * 1152921504606846976 + sum(((q * q) // 1073741824) * ((q * q) % 1073741824))::DOUBLE * 2147483648 + sum(((q * q) % 1073741824) * ((q * q) % 1073741824))::DOUBLE AS s4
  FROM q GROUP BY 1, 2, 3)"""


def queries() -> dict:
    return {
        "p1_found": lambda s, d: parse.failed_lines(table(s, d, "raw_samples")),
        "p1_loaded": lambda s, d: parse.loaded_rows(table(s, d, "raw_samples")),
        "p1_outcomes": lambda s, d: parse.failure_counts(table(s, d, "raw_samples")),
        "p2_found": lambda s, d: profile.load_findings(table(s, d, "samples"), table(s, d, "loads")),
        "p2_profile": lambda s, d: profile.column_profile(table(s, d, "samples")).select("load_id", "column_name", "n_rows", "n_missing", "n_violations", "n_distinct"),
        "p2_moments": lambda s, d: _six(profile.column_profile(table(s, d, "samples"), table(s, d, "loads"), table(s, d, "domains")).where("column_name <> 'hand'").select("load_id", "column_name", "n_rows", "n_missing", "n_violations", "n_distinct", "mean", "std", "skewness", "kurtosis")),
        "p2_ranges": lambda s, d: profile.column_profile(table(s, d, "samples"), table(s, d, "loads"), table(s, d, "domains")).select("load_id", "column_name", "min_value", "max_value", "q10_q50_q90"),
        "p2_shifts": lambda s, d: _six(profile.standardised_shifts(table(s, d, "samples"), table(s, d, "loads"), table(s, d, "domains"))),
        "p3_found": lambda s, d: spikes.implausible_readings(table(s, d, "samples"), table(s, d, "cases"), table(s, d, "domains")),
        "p4_found": lambda s, d: grid.missing_slots(table(s, d, "samples"), table(s, d, "cases")),
        "p4_grid": lambda s, d: _rounded_grid(grid.regular_grid(table(s, d, "samples"), table(s, d, "cases"))),
    }


def _six(df):
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _rounded_grid(df):
    from pyspark.sql import functions as F

    return df.withColumn("value", F.round("value", 9))


def oracle_sql() -> dict:
    limits = "+ 0.08"
    return {
        "p1_found": _CHECKED + "SELECT line_id, reason FROM checked WHERE reason IS NOT NULL",
        "p1_loaded": _CHECKED
        + """SELECT line_id, load_id, v[1] AS case_id,
             CAST(replace(replace(substr(v[2], 1, 26), 'T', ' '), 'Z', '') AS TIMESTAMP) AS t, l_num AS "L", v[4] AS hand,
             o_num AS "O", CASE WHEN isinf(w_num) THEN NULL ELSE w_num END AS omega, v[7] AS note
             FROM checked WHERE reason IS NULL""",
        "p1_outcomes": _CHECKED + "SELECT file_name, coalesce(reason, 'ok') AS outcome, count(*) AS n_lines FROM checked GROUP BY 1, 2",
        "p2_found": f"""
WITH s AS (
  SELECT a.load_id, l.domain, count(*) AS n,
    avg((L IS NULL OR isnan(L))::INT) AS l_miss, avg((O IS NULL OR isnan(O))::INT) AS o_miss, avg((hand IS NULL)::INT) AS h_miss,
    avg((hand NOT IN ('L', 'R'))::INT) AS h_bad, avg(CASE hand WHEN 'L' THEN 1.0 WHEN 'R' THEN 0.0 END) AS h_left,
    quantile_disc(CASE WHEN isfinite(L) THEN L END, [0.1, 0.5, 0.9]) AS lq, quantile_disc(CASE WHEN isfinite(O) THEN O END, [0.1, 0.5, 0.9]) AS oq
  FROM samples a LEFT JOIN loads l ON a.load_id = l.load_id WHERE a.load_id IS NOT NULL GROUP BY 1, 2),
m AS (
  SELECT *, median(l_miss) OVER w AS ml, median(o_miss) OVER w AS mo, median(h_miss) OVER w AS mh, median(h_bad) OVER w AS mb,
    median(lq[1]) OVER w AS l1, median(lq[2]) OVER w AS l2, median(lq[3]) OVER w AS l3,
    median(oq[1]) OVER w AS o1, median(oq[2]) OVER w AS o2, median(oq[3]) OVER w AS o3
  FROM s WINDOW w AS (PARTITION BY domain))
SELECT load_id, 'L' AS column_name, 'nulls' AS finding FROM m WHERE l_miss > ml {limits}
UNION ALL SELECT load_id, 'O', 'nulls' FROM m WHERE o_miss > mo {limits}
UNION ALL SELECT load_id, 'hand', 'nulls' FROM m WHERE h_miss > mh {limits}
UNION ALL SELECT load_id, 'hand', 'pattern' FROM m WHERE h_bad > mb + 0.05
UNION ALL SELECT load_id, 'hand', 'distribution' FROM m WHERE h_left NOT BETWEEN 0.35 AND 0.65
UNION ALL SELECT load_id, 'L', 'distribution' FROM m WHERE greatest(lq[1]/l1, l1/lq[1], lq[2]/l2, l2/lq[2], lq[3]/l3, l3/lq[3]) > 1.8
UNION ALL SELECT load_id, 'O', 'distribution' FROM m WHERE greatest(oq[1]/o1, o1/oq[1], oq[2]/o2, o2/oq[2], oq[3]/o3, o3/oq[3]) > 1.8""",
        "p2_profile": """
SELECT load_id, 'L' AS column_name, count(*) AS n_rows, count(*) FILTER (L IS NULL OR isnan(L)) AS n_missing,
  count(*) FILTER (isinf(L)) AS n_violations, count(DISTINCT L) AS n_distinct FROM samples GROUP BY 1
UNION ALL SELECT load_id, 'O', count(*), count(*) FILTER (O IS NULL OR isnan(O)), count(*) FILTER (isinf(O)), count(DISTINCT O) FROM samples GROUP BY 1
UNION ALL SELECT load_id, 'hand', count(*), count(*) FILTER (hand IS NULL), count(*) FILTER (hand NOT IN ('L', 'R')), count(DISTINCT hand) FROM samples GROUP BY 1""",
        "p2_moments": _STEPS
        + """, m AS (SELECT *, s1 / nullif(s0, 0) AS a, greatest(s2 / nullif(s0, 0) - (s1 / nullif(s0, 0)) * (s1 / nullif(s0, 0)), 0) AS m2, s2 / nullif(s0, 0) AS b2, s3 / nullif(s0, 0) AS b3, s4 / nullif(s0, 0) AS b4 FROM z)
            SELECT load_id, column_name, n_rows, n_missing, n_violations, n_distinct, round(a * u + c, 6) AS mean, round(CASE WHEN s0 > 0 THEN sqrt(m2) * u END, 6) AS std,
              round((b3 - 3 * a * b2 + 2 * a * a * a) / nullif(pow(m2, 1.5), 0), 6) AS skewness, round((b4 - 4 * a * b3 + 6 * a * a * b2 - 3 * a * a * a * a) / nullif(m2 * m2, 0), 6) AS kurtosis FROM m""",
        "p2_shifts": _STEPS
        + """, w AS (SELECT *, (sum(s0) OVER v - s0) AS r0, (sum(coalesce(e1, 0)) OVER v - coalesce(e1, 0))::DOUBLE AS r1, (sum(coalesce(e2, 0)) OVER v - coalesce(e2, 0))::DOUBLE AS r2 FROM z WHERE load_id IS NOT NULL WINDOW v AS (PARTITION BY domain, column_name)),
            m AS (SELECT *, coalesce(s1, 0) / nullif(s0, 0) AS a, r1 / nullif(r0, 0) AS b, greatest(coalesce(s2, 0) / nullif(s0, 0) - pow(coalesce(s1, 0) / nullif(s0, 0), 2), 0) AS va, greatest(r2 / nullif(r0, 0) - pow(r1 / nullif(r0, 0), 2), 0) AS vb FROM w)
            SELECT load_id, domain, column_name, s0::BIGINT AS n_finite, n_violations, round(a * u + c, 6) AS mean, round(b * u + c, 6) AS mean_rest,
              round(CASE WHEN s0 > 0 AND r0 > 0 THEN (a - b) / nullif(sqrt((va + vb) / 2), 0) END, 6) AS shift FROM m""",
        "p3_found": _spike_sql(),
        "p4_found": _P4 + "SELECT case_id, g AS slot_s FROM g WHERE g <> slot_s",
        "p4_grid": _P4
        + """SELECT case_id, g AS slot_s, CASE WHEN g = slot_s THEN 'observed' ELSE 'filled' END AS status,
             round(CASE WHEN g = slot_s THEN o ELSE o + (n_o - o) * ((g - slot_s) + step_s / 2.0 - into_us / 1e6) / ((n_slot - slot_s) + n_into / 1e6 - into_us / 1e6) END, 9) AS value,
             CASE WHEN g = slot_s THEN n_readings ELSE 0 END AS n_readings, (g = slot_s AND NOT near) AS break_after FROM g""",
    }
