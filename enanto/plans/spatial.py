"""Registered queries over located cases and the field derived from their pairs, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from ..session import table
from .contrast import PAIRS, half_up, pairs, rounded


def _grid(s, d):
    return spatial.derived_grid(pairs(s, d), table(s, d, "cases"))


def _hours(s, d):
    return spatial.derived_grid(pairs(s, d), table(s, d, "cases"), composite=True)


def _events(s, d):
    return spatial.storm_centres(table(s, d, "cases"))


def queries() -> dict:
    return {
        "derived_grid": _grid,
        "storm_centres": lambda s, d: _events(s, d),
        "tiles": lambda s, d: half_up(spatial.tiles(_events(s, d), _grid(s, d)), 9),
        "tangential_frames": lambda s, d: rounded(spatial.tangential_winds(_events(s, d), _grid(s, d))),
        "mirror_lon": lambda s, d: spatial.mirrored(_hours(s, d)),
        "parity_channels": lambda s, d: rounded(spatial.parity_channels(spatial.mirrored(_hours(s, d))).where("m_cell is not null").select("cell", "time", "speed_l", "speed_r", "eta_parity")),
        "mirror_audit": lambda s, d: rounded(spatial.mirror_audit(spatial.mirrored(_hours(s, d)))),
        "axis_sensitivity": lambda s, d: rounded(spatial.axis_sensitivity(_hours(s, d), _events(s, d))),
        "axis_robustness": lambda s, d: rounded(spatial.axis_robustness(spatial.axis_sensitivity(_hours(s, d), _events(s, d)))),
        "anomalies": lambda s, d: half_up(spatial.anomalies(_grid(s, d)), 9),
        "anomaly_audit": lambda s, d: rounded(spatial.anomaly_audit(_grid(s, d))),
        "offset_controls": lambda s, d: rounded(spatial.offset_controls(_events(s, d))),
        "matched_controls": lambda s, d: spatial.matched_controls(table(s, d, "cases")),
        "controls_for_all": lambda s, d: spatial.controls_for_all(table(s, d, "cases"), table(s, d, "samples")),
        "control_coverage": lambda s, d: rounded(spatial.control_coverage(table(s, d, "cases"))),
        "slice_status": lambda s, d: spatial.slice_status(table(s, d, "samples")),
    }


_GRID = PAIRS + """,
grid AS (SELECT pairs.case_id AS cell, lat0 AS lat, lon0 AS lon, date_trunc('hour', t)::TIMESTAMP AS time, sum(X_plus::DECIMAL(28, 12))::DOUBLE / count(*) AS u10, sum(X_minus::DECIMAL(28, 12))::DOUBLE / count(*) AS v10, count(*) AS n
  FROM pairs JOIN cases ON pairs.case_id = cases.case_id WHERE lat0 IS NOT NULL AND lon0 IS NOT NULL AND try_cast(X_plus AS DECIMAL(28, 12)) IS NOT NULL AND try_cast(X_minus AS DECIMAL(28, 12)) IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_HOURS = _GRID.replace("date_trunc('hour', t)::TIMESTAMP", "TIMESTAMP '2000-01-01' + to_hours(hour(t))")
_EVENTS = """
events AS (SELECT case_id, domain, case_type AS event_label, lat0, lon0, onset_time, floor(abs(lat0) / 5) * 5 AS lat_band
  FROM (SELECT *, CASE WHEN bool_or(case_type = 'storm') FILTER (onset_time IS NOT NULL AND lat0 IS NOT NULL) OVER (PARTITION BY domain) THEN 'storm' ELSE 'near_storm' END AS lab FROM cases)
  WHERE onset_time IS NOT NULL AND lat0 IS NOT NULL AND lon0 IS NOT NULL AND case_type = lab)"""


def _mirror(axis: str, name: str = "mir") -> str:
    return f""",
{name} AS (SELECT a.*, b.m_cell, b.m_lon, b.d AS m_dist, -b.u AS u10_mirror, b.v AS v10_mirror FROM grid a LEFT JOIN (
  SELECT a.cell, a.time, b.cell AS m_cell, b.lon AS m_lon, abs(b.lon - (2 * {axis} - a.lon)) AS d, b.u10 AS u, b.v10 AS v,
    row_number() OVER (PARTITION BY a.cell, a.time ORDER BY abs(b.lon - (2 * {axis} - a.lon)), b.cell) AS rk
  FROM grid a JOIN grid b ON a.time = b.time AND round_even(a.lat / 20, 0) = round_even(b.lat / 20, 0) AND a.cell <> b.cell AND abs(b.lon - (2 * {axis} - a.lon)) <= 20) b
  ON a.cell = b.cell AND a.time = b.time AND b.rk = 1)"""


_ETA = """sqrt(pow((u10 - u10_mirror) / 2, 2) + pow((v10 - v10_mirror) / 2, 2)) / (sqrt(pow((u10 - u10_mirror) / 2, 2) + pow((v10 - v10_mirror) / 2, 2))
  + sqrt(pow((u10 + u10_mirror) / 2, 2) + pow((v10 + v10_mirror) / 2, 2)) + 1e-8)"""
_AXES = (
    "WITH " + _HOURS + "," + _EVENTS + _mirror("170.0", "m1") + _mirror("180.0", "m2") + _mirror("190.0", "m3")
    + f""",
al AS (SELECT 170.0::DOUBLE AS lon0, * FROM m1 UNION ALL SELECT 180.0, * FROM m2 UNION ALL SELECT 190.0, * FROM m3),
sens AS (SELECT lon0, count(*) AS n_hits, avg({_ETA}) FILTER (cell IN (SELECT case_id FROM events)) AS event_mean, avg({_ETA}) FILTER (cell NOT IN (SELECT case_id FROM events)) AS background_mean
  FROM al WHERE m_cell IS NOT NULL GROUP BY 1)"""
)


def _anom(k1: str, k2: str, name: str) -> str:
    w = f"(PARTITION BY round_even(lat / 20, 0), round_even(lon / 60, 0), {k1}, {k2})"
    return f"{name} AS (SELECT cell, time, u10 - avg(u10) OVER {w} AS u_anom, v10 - avg(v10) OVER {w} AS v_anom, count(*) OVER {w} AS bin_count FROM grid)"


def oracle_sql() -> dict:
    tiers, left_e, left_c, parts = [], "ev", "co", []
    for i, (q, t, keys) in enumerate((("tier_a_exact", "A", ("domain", "step_s", "lat_bin", "lon_bin")), ("tier_b_lat", "B", ("domain", "lat_bin")), ("tier_c_domain", "C", ("domain",)))):
        k = ", ".join(keys)
        on = " AND ".join(f"e.{x} IS NOT DISTINCT FROM c.{x}" for x in keys)
        tiers.append(f"""h{i} AS (SELECT e.case_id, c.case_id AS control_id, '{q}' AS match_quality, '{t}' AS control_tier FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY md5(case_id), case_id) AS r FROM {left_e}) e
            JOIN (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY md5(case_id), case_id) AS r FROM {left_c}) c ON e.r = c.r AND {on}),
            ev{i} AS (SELECT * FROM {left_e} WHERE case_id NOT IN (SELECT case_id FROM h{i})), co{i} AS (SELECT * FROM {left_c} WHERE case_id NOT IN (SELECT control_id FROM h{i}))""")
        left_e, left_c = f"ev{i}", f"co{i}"
        parts.append(f"SELECT * FROM h{i}")
    return {
        "derived_grid": f"WITH {_GRID} SELECT cell, lat, lon, time, u10, v10, n FROM grid",
        "storm_centres": f"WITH {_EVENTS} SELECT * FROM events",
        "tiles": f"""WITH {_GRID},{_EVENTS} SELECT case_id, half::DOUBLE AS half, time, floor(avg(u10) * 1e9 + 0.5) / 1e9 AS u_mean, floor(avg(v10) * 1e9 + 0.5) / 1e9 AS v_mean, floor(avg(sqrt(u10 * u10 + v10 * v10)) * 1e9 + 0.5) / 1e9 AS speed_mean,
            floor(max(sqrt(u10 * u10 + v10 * v10)) * 1e9 + 0.5) / 1e9 AS speed_max, count(*) AS n_cells FROM events JOIN grid ON time BETWEEN onset_time - INTERVAL 240 HOUR AND onset_time + INTERVAL 240 HOUR
            CROSS JOIN (SELECT unnest([5.0, 15.0, 45.0]) AS half) WHERE abs(lat - lat0) <= half AND abs(lon - lon0) <= half GROUP BY 1, 2, 3""",
        "tangential_frames": f"""WITH {_GRID},{_EVENTS}, a AS (SELECT case_id, time, u10, v10, radians(lat) AS la, radians(lat0) AS l0, radians(lon) - radians(lon0) AS dl FROM events
              JOIN grid ON time BETWEEN onset_time - INTERVAL 240 HOUR AND onset_time + INTERVAL 240 HOUR AND abs(lat - lat0) <= 15 AND abs(lon - lon0) <= 15),
            b AS (SELECT *, cos(la) * sin(dl) AS ea, cos(l0) * sin(la) - sin(l0) * cos(la) * cos(dl) AS no FROM a),
            n AS (SELECT *, CASE WHEN sqrt(ea * ea + no * no) > 1e-12 THEN sqrt(ea * ea + no * no) ELSE 1 END AS nm FROM b)
            SELECT case_id, time, round(avg(u10 * -no / nm + v10 * ea / nm), 6) AS along, round(avg(u10 * ea / nm + v10 * no / nm), 6) AS across, count(*) AS n_cells FROM n GROUP BY 1, 2""",
        "mirror_lon": f"""WITH {_HOURS}{_mirror('180.0')} SELECT cell, time, lat AS lat, lon AS lon, u10 AS u10, v10 AS v10, m_cell, m_lon AS m_lon, m_dist AS m_dist,
            u10_mirror AS u10_mirror, v10_mirror AS v10_mirror FROM mir""",
        "parity_channels": f"""WITH {_HOURS}{_mirror('180.0')} SELECT cell, time, round(sqrt(u10 * u10 + v10 * v10), 6) AS speed_l, round(sqrt(u10_mirror * u10_mirror + v10_mirror * v10_mirror), 6) AS speed_r, round({_ETA}, 6) AS eta_parity
            FROM mir WHERE m_cell IS NOT NULL""",
        "mirror_audit": f"""WITH {_HOURS}{_mirror('180.0')} SELECT count(*) AS n_rows, count(m_dist) AS n_hits, round(avg((m_dist IS NOT NULL)::INT), 6) AS hit_rate, round(avg(m_dist), 6) AS dist_mean, round(min(m_dist), 6) AS dist_min,
            round(max(m_dist), 6) AS dist_max, {', '.join(f'count(*) FILTER (m_dist >= {a} AND m_dist < {b}) AS bin_{i}' for i, (a, b) in enumerate(zip((0, 1, 2, 5, 10, 20), (1, 2, 5, 10, 20, 1e300))))} FROM mir""",
        "axis_sensitivity": _AXES + " SELECT lon0, n_hits, round(event_mean, 6) AS event_mean, round(background_mean, 6) AS background_mean, round(event_mean - background_mean, 6) AS contrast FROM sens",
        "axis_robustness": _AXES + """, c AS (SELECT lon0, event_mean - background_mean AS c FROM sens WHERE event_mean - background_mean IS NOT NULL)
            SELECT count(*) AS n_axes, round(stddev_pop(c), 6) AS contrast_std, round(abs(avg(sign(c))), 6) AS sign_consistency, round(regr_slope(c, lon0), 6) AS slope, arg_max(lon0, c) AS lon0_max, arg_min(lon0, c) AS lon0_min FROM c""",
        "anomalies": f"WITH {_GRID}, {_anom('hour(time)', 'month(time)', 'a')} SELECT cell, time, floor(u_anom * 1e9 + 0.5) / 1e9 AS u_anom, floor(v_anom * 1e9 + 0.5) / 1e9 AS v_anom, bin_count FROM a",
        "anomaly_audit": f"""WITH {_GRID}, {_anom('hour(time)', 'month(time)', 'a1')}, {_anom('dayofyear(time)', '0', 'a2')}, {_anom('0', '0', 'a3')},
            u AS (SELECT 'lat_hour' AS mode, 0 AS i, * FROM a1 UNION ALL SELECT 'lat_day', 1, * FROM a2 UNION ALL SELECT 'none', 2, * FROM a3),
            g AS (SELECT mode, i, median(bin_count) AS bm, avg((bin_count >= 3)::INT) AS cov, sqrt(avg(u_anom * u_anom)) AS ur, sqrt(avg(v_anom * v_anom)) AS vr FROM u GROUP BY 1, 2)
            SELECT mode, round(bm, 6) AS bin_count_median, round(cov, 6) AS coverage, round(ur, 6) AS u_rms, round(vr, 6) AS v_rms, i = min(CASE WHEN cov >= 0.5 OR mode = 'none' THEN i END) OVER () AS used FROM g""",
        "offset_controls": f"""WITH {_EVENTS}, a AS (SELECT *, greatest(0, least(360, CASE WHEN lon0 + 60 > 360 THEN lon0 - 60 ELSE lon0 + 60 END)) AS l FROM events)
            SELECT case_id, replace(case_id, 'storm_', 'ctrl_') AS control_id, round(lat0, 6) AS lat0, round(l, 6) AS lon0, round(abs(l - lon0), 6) AS dist_deg, floor(abs(l - lon0) / 2) * 2.0 AS dist_bin_deg, 'C' AS control_tier FROM a""",
        "matched_controls": """WITH b AS (SELECT case_id, domain, step_s, case_type, coalesce(round_even(lat0 / 20, 0) * 20, 0) AS lat_bin, coalesce(round_even(lon0 / 60, 0) * 60, 0) AS lon_bin FROM cases WHERE case_id IS NOT NULL),
            ev AS (SELECT * FROM b WHERE case_type IN ('storm', 'near_storm')), co AS (SELECT * FROM b WHERE case_type = 'control'), """ + ", ".join(tiers) + " " + " UNION ALL ".join(parts),
        "control_coverage": """SELECT domain, count(*) FILTER (case_type IN ('storm', 'near_storm')) AS n_events, count(*) FILTER (case_type = 'control') AS n_controls, count(DISTINCT control_tier) AS n_tiers,
            round(count(*) FILTER (case_type IN ('storm', 'near_storm')) / nullif(count(*) FILTER (case_type = 'control'), 0), 6) AS events_per_control FROM cases WHERE case_id IS NOT NULL GROUP BY 1""",
        "slice_status": """WITH x AS (SELECT DISTINCT case_id, t, L, hand FROM samples WHERE case_id IS NOT NULL AND t IS NOT NULL AND L IS NOT NULL AND NOT isnan(L) AND hand IN ('L', 'R')),
            w AS (SELECT case_id, count(DISTINCT L) * 2 AS e FROM x GROUP BY 1), h AS (SELECT case_id, t, count(*) AS n FROM x GROUP BY 1, 2)
            SELECT h.case_id, CASE WHEN n = e THEN 'whole' ELSE 'partial' END AS status, count(*) AS n_slices FROM h JOIN w ON h.case_id = w.case_id GROUP BY 1, 2""",
    }
