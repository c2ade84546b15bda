"""SQL text of the shared tables that the registered SQL counterparts build on.

Written for a single-node SQL engine straight from the definitions (framed windows, pair joins), on
purpose without the chunking and running sums of the Spark side.
"""

from __future__ import annotations

import re

WEEK, DAY3, DAY1, TOL, HOUR1 = 604_800_000_000, 259_200_000_000, 86_400_000_000, 10_800_000_000, 3_600_000_000
ORIGIN = 1_577_836_800_000_000


def _rounded(e: str, offset: str, digits: int) -> str:
    """Rounded double without a negative zero."""
    r = f"round(({e}) + {offset}, {digits})"
    return f"(CASE WHEN {r} = 0 THEN 0e0 ELSE {r} END)"


def R(e: str) -> str:
    return _rounded(e, "3e-8", 6)


def R4(e: str) -> str:
    return _rounded(e, "3e-6", 4)


def clip01(e: str) -> str:
    return f"(CASE WHEN ({e}) IS NOT NULL THEN least(1e0, greatest(0e0, {e})) END)"


def by_var(t: object, p: object, h: object, key: str = "variable") -> str:
    return f"(CASE {key} WHEN 'temperature' THEN {t} WHEN 'pressure' THEN {p} ELSE {h} END)"


def std(e: str) -> str:
    return f"(CASE WHEN {e} < 1e-5 THEN 0e0 ELSE {e} END)"


def whole(e: str) -> str:
    return f"CAST(CAST(floor(({e}) + 0.5 + 1e-7) AS BIGINT) AS VARCHAR)"


SCALE = by_var("8e0", "5e0", "25e0")
LO, HI = by_var("-90e0", "850e0", "0e0"), by_var("60e0", "1090e0", "100e0")
BAD = f"(x IS NULL OR x NOT BETWEEN {LO} AND {HI})"


def finite(e: str) -> str:
    return f"CASE WHEN isfinite({e}) THEN {e} END"


FRAME = f"PARTITION BY station_id, variable ORDER BY t RANGE BETWEEN {WEEK} PRECEDING AND 1 PRECEDING"
ROW = "PARTITION BY station_id, variable ORDER BY t, reading_id"

CTES: dict[str, str] = {
    "readings": """
 SELECT 'R' || event_id AS reading_id, 'AWS-' || user_id AS station_id, ts, epoch_us(ts) AS t,
  CASE WHEN event_type = 'error' AND k >= 95 THEN NULL
       ELSE 20e0 - 0.5e0 * abs(hour(ts) - 14) + value / 32e0
            + CASE WHEN event_type = 'error' AND k < 10 THEN 30e0 ELSE 0e0 END END AS temperature,
  CAST(1000 + day(ts) % 10 AS DOUBLE) + (event_id % 7) / 8e0 AS pressure,
  60e0 + 2e0 * abs(hour(ts) - 14) + (k - 50) / 8e0 AS humidity,
  CASE WHEN event_type = 'error' AND k >= 95 THEN 'dropout'
       WHEN event_type = 'error' AND k < 10 THEN 'temperature_spike' END AS truth,
  event_id AS seq, k, user_id
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "stations": """
 SELECT DISTINCT 'AWS-' || user_id AS station_id, 20e0 + (user_id % 50) * 0.1e0 AS latitude,
  70e0 + (user_id // 50) * 0.1e0 AS longitude, CAST(user_id * 37 % 900 AS DOUBLE) AS elevation,
  CAST(user_id % 5 AS INTEGER) AS region, user_id AS station_no FROM events""",
    "sensors": """
 SELECT station_id || ':' || variable AS sensor_id, station_id, variable,
  CAST(DATE '2023-01-01' + CAST((station_no * 13 + i * 7) % 365 AS INTEGER) AS DATE) AS calibration_date
 FROM stations, (VALUES ('temperature', 0), ('pressure', 1), ('humidity', 2)) AS v(variable, i)""",
    "dirty": """
 SELECT reading_id, CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 83 = 0 THEN 'AWS-UNKNOWN' ELSE station_id END
   AS station_id, ts, t, CASE WHEN seq % 89 = 0 THEN temperature + 100 ELSE temperature END AS temperature,
  pressure, CASE seq % 50 WHEN 0 THEN humidity + 60 WHEN 1 THEN humidity - 100 ELSE humidity END AS humidity,
  seq FROM readings
 UNION ALL
 SELECT reading_id || '-dup', CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 83 = 0 THEN 'AWS-UNKNOWN'
   ELSE station_id END, ts, t, CASE WHEN seq % 89 = 0 THEN temperature + 100 ELSE temperature END,
  pressure, CASE seq % 50 WHEN 0 THEN humidity + 60 WHEN 1 THEN humidity - 100 ELSE humidity END, seq
 FROM readings WHERE seq % 50 = 3""",
    # x: the finite value; u: the one that other readings may rely on.
    "obs": f"""
 SELECT *, CASE WHEN x BETWEEN {LO} AND {HI} THEN x END AS u FROM (
 SELECT reading_id, station_id, ts, t, 'temperature' AS variable, {finite('temperature')} AS x FROM readings
 UNION ALL SELECT reading_id, station_id, ts, t, 'pressure', {finite('pressure')} FROM readings
 UNION ALL SELECT reading_id, station_id, ts, t, 'humidity', {finite('humidity')} FROM readings)""",
    "roll": f"""
 SELECT *, {std('std0')} AS std FROM (
  SELECT *, count(u) OVER w AS n, avg(u) OVER w AS mean, stddev_samp(u) OVER w AS std0
  FROM obs WINDOW w AS ({FRAME}))""",
    "fit": f"""
 SELECT *, CASE WHEN n >= 8 AND spread > 1e-6 THEN slope0 END AS slope,
  CASE WHEN n >= 8 AND spread > 1e-6 THEN icpt + slope0 * tau END AS predicted
 FROM (SELECT *, count(u) OVER w AS n, regr_slope(u, tau) OVER w AS slope0,
   regr_intercept(u, tau) OVER w AS icpt, regr_sxx(u, tau) OVER w AS spread
  FROM (SELECT *, (t - {ORIGIN}) / 86400000000e0 AS tau FROM obs) WINDOW w AS ({FRAME}))""",
    "quant": f"""
 SELECT *, CASE WHEN n >= 8 THEN a END AS q_lo, CASE WHEN n >= 8 THEN b END AS q25,
  CASE WHEN n >= 8 THEN c END AS q75, CASE WHEN n >= 8 THEN d END AS q_hi
 FROM (SELECT *, count(u) OVER w AS n, quantile_cont(u, 0.05) OVER w AS a, quantile_cont(u, 0.25) OVER w AS b,
   quantile_cont(u, 0.75) OVER w AS c, quantile_cont(u, 0.95) OVER w AS d
  FROM obs WINDOW w AS ({FRAME}))""",
    "stat": f"""
 SELECT s.*, {clip01('abs(z) / 6')} AS z_signal, {clip01('dist / iqr')} AS q_signal,
  greatest({clip01('abs(z) / 6')}, {clip01('dist / iqr')}) AS stat
 FROM (SELECT r.*, CASE WHEN r.n >= 8 AND r.std > 0 THEN (r.x - r.mean) / r.std END AS z,
   CASE WHEN r.x IS NOT NULL AND q.q_lo IS NOT NULL
        THEN greatest(q.q_lo - r.x, r.x - q.q_hi, 0e0) END AS dist,
   nullif(q.q75 - q.q25, 0e0) AS iqr
  FROM roll r JOIN quant q USING (reading_id, variable)) s""",
    "flagged": f"""
 SELECT reading_id, station_id, ts, t, statistical, structural,
  structural OR coalesce(statistical >= 0.5, false) AS anomaly,
  CASE WHEN structural THEN 1e0 ELSE coalesce(statistical, 0e0) END AS anomaly_score,
  CASE WHEN kt >= kp AND kt >= kh THEN 'temperature' WHEN kp >= kh THEN 'pressure' ELSE 'humidity' END AS focus
 FROM (SELECT reading_id, any_value(station_id) AS station_id, any_value(ts) AS ts, any_value(t) AS t,
   max(stat) AS statistical, bool_or({BAD}) AS structural,
   max(CASE WHEN {BAD} THEN 2e0 ELSE coalesce(stat, -1e0) END) FILTER (WHERE variable = 'temperature') AS kt,
   max(CASE WHEN {BAD} THEN 2e0 ELSE coalesce(stat, -1e0) END) FILTER (WHERE variable = 'pressure') AS kp,
   max(CASE WHEN {BAD} THEN 2e0 ELSE coalesce(stat, -1e0) END) FILTER (WHERE variable = 'humidity') AS kh
  FROM stat GROUP BY reading_id)""",
    "adj": f"""
 SELECT *, t - prev_t AS gap_us, (x - prev_x) / nullif((t - prev_t) / 60000000e0, 0e0) AS rate
 FROM (SELECT *, lag(t) OVER w AS prev_t, lead(t) OVER w AS next_t, lag(u) OVER w AS prev_x,
   lead(u) OVER w AS next_x FROM obs WINDOW w AS ({ROW}))""",
    "blocks": f"""
 SELECT *, count(u) OVER a AS pre_n, avg(u) OVER a AS pre_mean, stddev_samp(u) OVER a AS pre_std,
  count(u) OVER b AS post_n, avg(u) OVER b AS post_mean FROM adj
 WINDOW a AS ({ROW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
        b AS ({ROW} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""",
    "daily": """
 SELECT station_id, variable, hour(ts) AS hour, count(u) AS dn, avg(u) AS dmean, stddev_samp(u) AS dstd
 FROM obs GROUP BY ALL""",
    "temporal": f"""
 SELECT reading_id, station_id, variable, rate_excess, CASE WHEN rate_excess IS NOT NULL THEN
   1 - greatest(rate_excess, 0.3e0 * trend_excess, 0.3e0 * daily_excess) END AS temporal
 FROM (SELECT a.reading_id, a.station_id, a.variable,
   CASE WHEN a.gap_us <= {HOUR1} THEN {clip01(f"(abs(a.rate) - {by_var('1e0', '1e0', '5e0', 'a.variable')}) / {by_var('9e0', '4e0', '25e0', 'a.variable')}")} END AS rate_excess,
   {clip01('abs(f.x - f.predicted) / nullif(6 * r.std, 0e0)')} AS trend_excess,
   CASE WHEN d.dn >= 8 THEN {clip01('abs(a.x - d.dmean) / nullif(6 * d.dstd, 0e0)')} END AS daily_excess
  FROM adj a JOIN roll r USING (reading_id, variable) JOIN fit f USING (reading_id, variable)
  JOIN daily d ON d.station_id = a.station_id AND d.variable = a.variable AND d.hour = hour(a.ts))""",
    "clean": f"""
 SELECT reading_id, station_id, t, seq, {finite('temperature')} AS te, {finite('pressure')} AS pr, {finite('humidity')} AS hu,
  CASE WHEN temperature BETWEEN -90 AND 60 THEN temperature END AS ute, CASE WHEN pressure BETWEEN 850 AND 1090 THEN pressure END AS upr,
  CASE WHEN humidity BETWEEN 0 AND 100 THEN humidity END AS uhu FROM readings""",
    "pairs": f"""
 SELECT reading_id, station_id, t, te, pr, hu,
  CASE WHEN regr_count(ute, upr) OVER w >= 8 AND var_samp(CASE WHEN upr IS NOT NULL THEN ute END) OVER w > 1e-9
   AND var_samp(CASE WHEN ute IS NOT NULL THEN upr END) OVER w > 1e-9 THEN corr(ute, upr) OVER w END AS corr_temperature_pressure,
  CASE WHEN regr_count(ute, uhu) OVER w >= 8 AND var_samp(CASE WHEN uhu IS NOT NULL THEN ute END) OVER w > 1e-9
   AND var_samp(CASE WHEN ute IS NOT NULL THEN uhu END) OVER w > 1e-9 THEN corr(ute, uhu) OVER w END AS corr_temperature_humidity,
  CASE WHEN regr_count(upr, uhu) OVER w >= 8 AND var_samp(CASE WHEN uhu IS NOT NULL THEN upr END) OVER w > 1e-9
   AND var_samp(CASE WHEN upr IS NOT NULL THEN uhu END) OVER w > 1e-9 THEN corr(upr, uhu) OVER w END AS corr_pressure_humidity,
  CASE WHEN regr_count(ute, uhu) OVER v >= 8 AND var_samp(CASE WHEN uhu IS NOT NULL THEN ute END) OVER v > 1e-9
   AND var_samp(CASE WHEN ute IS NOT NULL THEN uhu END) OVER v > 1e-9 THEN corr(ute, uhu) OVER v END AS recent_th
 FROM clean WINDOW
  w AS (PARTITION BY station_id ORDER BY t RANGE BETWEEN {WEEK} PRECEDING AND 1 PRECEDING),
  v AS (PARTITION BY station_id ORDER BY t RANGE BETWEEN {DAY3} PRECEDING AND 1 PRECEDING)""",
    "sensor_terms": """
 SELECT *, CASE WHEN dew_point > 35 THEN 0e0 WHEN dew_point IS NOT NULL THEN 1e0 END AS dew_term,
  CASE WHEN d_t IS NULL OR d_rh IS NULL THEN NULL WHEN abs(d_t) < 5 THEN 1e0
       ELSE 1 - least(1e0, greatest(0e0, 1 - (-sign(d_t) * d_rh) / (2 * abs(d_t)))) END AS t_rh
 FROM (SELECT *, CASE WHEN te IS NOT NULL AND hu > 0 AND te > -243.12
     THEN 243.12e0 * gamma / (17.62e0 - gamma) END AS dew_point
  FROM (SELECT reading_id, station_id, te, hu, te - lag(ute) OVER w AS d_t, hu - lag(uhu) OVER w AS d_rh,
    pr - lag(upr) OVER w AS d_p, 2e0 * (seq % 11) - lag(2e0 * (seq % 11)) OVER w AS d_w,
    CASE WHEN hu > 0 THEN ln(hu / 100) + 17.62e0 * te / (te + 243.12e0) END AS gamma
   FROM clean WINDOW w AS (PARTITION BY station_id ORDER BY t, reading_id)))""",
    "sensor_ev": """
 SELECT reading_id, station_id, dew_term, t_rh, corr_term, CASE WHEN dew_term = 0 THEN 0e0
   WHEN t_rh IS NULL THEN corr_term WHEN corr_term IS NULL THEN t_rh ELSE (t_rh + corr_term) / 2 END AS cross_sensor
 FROM (SELECT s.*, 1 - abs(p.recent_th - p.corr_temperature_humidity) / 2 AS corr_term
  FROM sensor_terms s JOIN pairs p USING (reading_id))""",
    "neigh": """
 SELECT * FROM (SELECT a.station_id, b.station_id AS neighbour_id, 12742e0 * asin(sqrt(least(1e0,
   pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude))
   * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) AS km
  FROM stations a JOIN stations b ON a.station_id <> b.station_id) WHERE km <= 30""",
    "aligned": f"""
 SELECT r.reading_id, r.station_id, r.variable, r.x AS own, r.t, e.neighbour_id, e.km, o.u AS x, o.t AS o_t, o.reading_id AS o_id
 FROM obs r JOIN neigh e ON e.station_id = r.station_id
 JOIN obs o ON o.station_id = e.neighbour_id AND o.variable = r.variable
  AND o.t BETWEEN r.t - {TOL} AND r.t + {TOL} WHERE o.u IS NOT NULL""",
    "nearest": """
 SELECT * FROM aligned QUALIFY row_number() OVER (PARTITION BY reading_id, variable, neighbour_id
  ORDER BY abs(o_t - t), o_t > t, o_id DESC) = 1""",
    "idw": f"""
 SELECT o.*, g.idw, coalesce(g.nn, 0) AS nn, coalesce(g.agree, 0) AS agree, g.spread,
  CASE WHEN g.nn >= 2 AND o.x IS NOT NULL THEN greatest(0e0, 1 - abs(o.x - g.idw)
   / {by_var('8e0', '5e0', '25e0', 'o.variable')}) END AS cross_station
 FROM obs o LEFT JOIN (SELECT reading_id, variable, sum(x / pow(greatest(km, 0.1e0), 2)) / sum(1 / pow(greatest(km, 0.1e0), 2))
   AS idw, count(*) AS nn, count(*) FILTER (WHERE abs(x - own) <= {SCALE}) AS agree, stddev_samp(x) AS spread
  FROM nearest GROUP BY reading_id, variable) g USING (reading_id, variable)""",
    "persist": f"""
 SELECT reading_id, avg(CASE WHEN anomaly THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY station_id ORDER BY t
   RANGE BETWEEN {DAY1} PRECEDING AND 1 PRECEDING) AS persistence FROM flagged""",
    "vector": f"""
 SELECT *, CASE WHEN temporal IS NULL THEN 0e0 ELSE 0.25e0 END + CASE WHEN cross_sensor IS NULL THEN 0e0 ELSE 0.25e0 END
   + CASE WHEN cross_station IS NULL THEN 0e0 ELSE 0.4e0 END + CASE WHEN persistence IS NULL THEN 0e0 ELSE 0.1e0 END
   AS coverage0, greatest(temporal, cross_sensor, cross_station) - least(temporal, cross_sensor, cross_station) AS conflict
 FROM (SELECT f.*, i.x, i.idw, i.nn, i.agree, t.temporal, s.cross_sensor, i.cross_station, p.persistence,
   i.x IS NOT NULL AND i.u IS NULL AS impossible,
   i.u IS NULL AND ((a.prev_t IS NOT NULL AND a.prev_x IS NULL) OR (a.next_t IS NOT NULL AND a.next_x IS NULL))
    AS missing_run
  FROM flagged f JOIN idw i ON i.reading_id = f.reading_id AND i.variable = f.focus
  JOIN temporal t ON t.reading_id = f.reading_id AND t.variable = f.focus
  JOIN adj a ON a.reading_id = f.reading_id AND a.variable = f.focus
  JOIN sensor_ev s ON s.reading_id = f.reading_id JOIN persist p ON p.reading_id = f.reading_id)""",
    "judged": """
 SELECT *, coalesce(coverage * greatest(g, 1 - g), 0e0) AS confidence,
  CAST(least(100, greatest(0, floor(100 * (1 - anomaly_score * (1 - coalesce(g * coverage, 0e0))) + 0.5 + 1e-7))) AS INTEGER) AS trust_score,
  CASE WHEN NOT anomaly THEN NULL WHEN missing_run OR impossible THEN 'sensor_fault'
   WHEN g IS NULL OR coverage < 0.6 - 1e-9 OR coalesce(conflict > 0.6, false) THEN 'uncertain'
   WHEN g >= 0.65 THEN 'genuine_weather' WHEN g <= 0.35 THEN 'sensor_fault' ELSE 'uncertain' END AS decision
 FROM (SELECT *, CASE WHEN missing_run OR impossible THEN 1e0 ELSE coverage0 END AS coverage,
   CASE WHEN missing_run OR impossible THEN 0e0 ELSE
   (coalesce(temporal * 0.25e0, 0) + coalesce(cross_sensor * 0.25e0, 0) + coalesce(cross_station * 0.4e0, 0)
    + coalesce((1 - persistence) * 0.1e0, 0)) / nullif(coverage0, 0) END AS g FROM vector)""",
    "spikes": f"""
 SELECT *, coalesce(abs(x - prev_x) >= {SCALE} AND abs(next_x - prev_x) <= 0.5 * abs(x - prev_x), false) AS is_spike
 FROM blocks""",
    "jumps": """
 SELECT *, coalesce(pre_n = 5 AND post_n = 5 AND pre_std > 1e-5 AND abs(post_mean - pre_mean) > 3 * pre_std
  AND abs(x - pre_mean) >= abs(post_mean - pre_mean) / 2 AND NOT is_spike, false) AS is_jump FROM spikes""",
    "gaps": """
 SELECT *, floor((t - lag(t) OVER (PARTITION BY station_id ORDER BY t, reading_id)) / 1e6) AS gap_s FROM readings""",
    "cadence": "SELECT station_id, quantile_cont(gap_s, 0.5) AS cadence_s FROM gaps GROUP BY station_id",
    "dropouts": """
 SELECT a.reading_id, a.station_id, a.variable, a.x IS NULL OR (a.u IS NULL AND ((a.prev_t IS NOT NULL
   AND a.prev_x IS NULL) OR (a.next_t IS NOT NULL AND a.next_x IS NULL))) OR coalesce(floor(a.gap_us / 1e6) > 4 * c.cadence_s, false)
  AS is_dropout FROM adj a LEFT JOIN cadence c USING (station_id)""",
    "runs": f"""
 SELECT reading_id, station_id, variable, CASE WHEN u IS NULL THEN 0 ELSE
   count(*) OVER (PARTITION BY station_id, variable, run) END AS run_length
 FROM (SELECT *, sum(CASE WHEN prev_t IS NULL OR u IS DISTINCT FROM prev_x THEN 1 ELSE 0 END) OVER ({ROW}) AS run
  FROM adj)""",
    "resid": f"""
 SELECT *, coalesce(abs(slope) > {by_var('0.1e0', '0.1e0', '0.5e0')}, false) AS is_drift,
  coalesce(rn >= 8 AND abs(rmean) >= 0.5 * {SCALE} AND rstd <= 0.25 * {SCALE}, false) AS is_bias,
  coalesce(noise_level > 3, false) AS is_noise
 FROM (SELECT *, CASE WHEN rn >= 8 AND spread > 1e-6 THEN slope0 END AS slope,
   CASE WHEN dayn >= 3 AND n >= 8 THEN {std('daystd')} / nullif({std('std0')}, 0e0) END AS noise_level
  FROM (SELECT *, count(r) OVER w AS rn, avg(r) OVER w AS rmean, stddev_samp(r) OVER w AS rstd,
    regr_slope(r, tau) OVER w AS slope0, regr_sxx(r, tau) OVER w AS spread,
    count(u) OVER w AS n, stddev_samp(u) OVER w AS std0, count(u) OVER d AS dayn, stddev_samp(u) OVER d AS daystd
   FROM (SELECT reading_id, station_id, ts, t, variable, u, u - idw AS r, (t - {ORIGIN}) / 86400000000e0 AS tau FROM idw)
   WINDOW w AS ({FRAME}), d AS (PARTITION BY station_id, variable ORDER BY t
    RANGE BETWEEN {DAY1} PRECEDING AND 1 PRECEDING)))""",
    "faults": """
 SELECT *, CASE archetype WHEN 'dropout' THEN 'dropout' WHEN 'frozen' THEN 'frozen_sensor'
   WHEN 'spike' THEN CASE WHEN focus = 'temperature' THEN 'temperature_spike' END WHEN 'jump' THEN 'abrupt_jump'
   WHEN 'drift' THEN CASE WHEN focus = 'temperature' THEN 'temperature_drift' END WHEN 'noise' THEN 'noise'
   WHEN 'bias' THEN 'bias' WHEN 'inconsistent' THEN 'multivariate_inconsistency' END AS fault_type
 FROM (SELECT j.*, CASE WHEN j.decision IS DISTINCT FROM 'sensor_fault' THEN NULL WHEN d.is_dropout THEN 'dropout'
   WHEN r.run_length >= 5 THEN 'frozen' WHEN k.is_spike THEN 'spike' WHEN k.is_jump THEN 'jump'
   WHEN z.is_drift THEN 'drift' WHEN z.is_noise THEN 'noise' WHEN z.is_bias THEN 'bias'
   WHEN j.cross_sensor < 0.3 AND (j.temporal IS NULL OR j.temporal >= 0.7) THEN 'inconsistent' END AS archetype
  FROM judged j JOIN dropouts d ON d.reading_id = j.reading_id AND d.variable = j.focus
  JOIN runs r ON r.reading_id = j.reading_id AND r.variable = j.focus
  JOIN jumps k ON k.reading_id = j.reading_id AND k.variable = j.focus
  JOIN resid z ON z.reading_id = j.reading_id AND z.variable = j.focus)""",
    "interp": f"""
 SELECT reading_id, station_id, variable, CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL THEN x0
   WHEN t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * ((t - t0) / CAST(t1 - t0 AS DOUBLE)) END AS interpolated
 FROM (SELECT *, last_value(kx IGNORE NULLS) OVER b AS x0, last_value(kt IGNORE NULLS) OVER b AS t0,
   first_value(kx IGNORE NULLS) OVER a AS x1, first_value(kt IGNORE NULLS) OVER a AS t1
  FROM (SELECT o.*, CASE WHEN NOT f.anomaly THEN o.x END AS kx,
    CASE WHEN NOT f.anomaly AND o.x IS NOT NULL THEN o.t END AS kt
   FROM obs o JOIN flagged f USING (reading_id))
  WINDOW b AS ({ROW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
   a AS ({ROW} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
    "suggested": f"""
 SELECT *, CASE WHEN decision IN ('sensor_fault', 'uncertain') THEN focus END AS suggested_variable,
  CASE WHEN decision IN ('sensor_fault', 'uncertain') AND guess IS NOT NULL THEN least(greatest(guess,
   {by_var('-90e0', '850e0', '0e0', 'focus')}), {by_var('60e0', '1090e0', '100e0', 'focus')}) END AS suggested_value
 FROM (SELECT f.*, n.interpolated, CASE WHEN n.interpolated IS NULL THEN f.idw WHEN f.idw IS NULL THEN n.interpolated
   ELSE (n.interpolated + f.idw) / 2 END AS guess
  FROM faults f JOIN interp n ON n.reading_id = f.reading_id AND n.variable = f.focus)""",
    "correction_events": """
 SELECT 'R' || o_custkey AS reading_id, o_orderkey AS event_no, CAST(o_orderdate AS TIMESTAMP) AS event_ts,
  CASE o_orderkey % 4 WHEN 0 THEN 'SUGGESTED' WHEN 1 THEN 'PENDING_REVIEW' WHEN 2 THEN 'ACCEPTED' ELSE 'REJECTED' END
   AS status, 'reviewer-' || (o_orderkey % 7) AS actor FROM orders""",
    "steps": """
 SELECT *, rn IS NOT DISTINCT FROM v OR rn IS NOT DISTINCT FROM p OR rn IS NOT DISTINCT FROM s AS legal
 FROM (SELECT *, min(CASE WHEN status IN ('ACCEPTED', 'REJECTED') AND rn > p THEN rn END) OVER w AS v
  FROM (SELECT *, min(CASE WHEN status = 'PENDING_REVIEW' AND rn > s THEN rn END) OVER w AS p
   FROM (SELECT *, min(CASE WHEN status = 'SUGGESTED' THEN rn END) OVER w AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY event_ts, event_no) AS rn
     FROM correction_events) WINDOW w AS (PARTITION BY reading_id)) WINDOW w AS (PARTITION BY reading_id))
  WINDOW w AS (PARTITION BY reading_id))""",
    "status": """
 SELECT reading_id, arg_max(status, rn) FILTER (WHERE legal) AS status,
  arg_max(event_ts, rn) FILTER (WHERE legal) AS reviewed_at, arg_max(actor, rn) FILTER (WHERE legal) AS reviewed_by,
  count(*) AS n_events, count(*) FILTER (WHERE NOT legal) AS n_illegal FROM steps GROUP BY reading_id""",
    "corrected": """
 SELECT r.*, CASE WHEN s.suggested_variable = 'temperature' AND s.suggested_value IS NOT NULL THEN s.suggested_value
   ELSE r.temperature END AS corrected_temperature, CASE WHEN s.suggested_variable = 'pressure'
   AND s.suggested_value IS NOT NULL THEN s.suggested_value ELSE r.pressure END AS corrected_pressure,
  CASE WHEN s.suggested_variable = 'humidity' AND s.suggested_value IS NOT NULL THEN s.suggested_value
   ELSE r.humidity END AS corrected_humidity
 FROM readings r LEFT JOIN (SELECT * FROM suggested WHERE reading_id IN
  (SELECT reading_id FROM status WHERE status = 'ACCEPTED')) s USING (reading_id)""",
    "sensor_faults": """
 SELECT reading_id, station_id, focus AS variable, ts, t, coalesce(fault_type, 'unclassified') AS fault_type
 FROM faults WHERE decision = 'sensor_fault'""",
    "drifts": f"""
 SELECT station_id, variable, count(*) AS n, CASE WHEN count(*) >= 8 THEN regr_slope(r, tau) END AS drift_rate,
  CASE WHEN count(*) >= 8 THEN regr_slope(r, tau) * (max(tau) - min(tau)) END AS cumulative_drift
 FROM (SELECT station_id, variable, u - idw AS r, (t - {ORIGIN}) / 86400000000e0 AS tau FROM idw) WHERE r IS NOT NULL
 GROUP BY station_id, variable""",
    "floors": """
 SELECT station_id, variable, quantile_cont(std, 0.1) AS noise_floor
 FROM roll WHERE n >= 8 AND std IS NOT NULL GROUP BY station_id, variable""",
    "health": f"""
 SELECT *, greatest(0e0, 100 - 40 * coalesce({clip01(f"abs(drift_rate) / (4 * {by_var('0.1e0', '0.1e0', '0.5e0')})")}, 0)
   - 40 * coalesce({clip01('failure_count / CAST(n_readings AS DOUBLE) / 0.2')}, 0)
   - 10 * coalesce({clip01(f'noise_floor / {SCALE}')}, 0) - 10 * coalesce({clip01('age_days / 365e0')}, 0)) AS health_score
 FROM (SELECT s.sensor_id, s.station_id, s.variable, s.calibration_date,
   date_diff('day', s.calibration_date, (SELECT CAST(max(ts) AS DATE) FROM events)) AS age_days, r.n_readings,
   coalesce(f.n, 0) AS failure_count, d.drift_rate, d.cumulative_drift, l.noise_floor
  FROM sensors s LEFT JOIN (SELECT station_id, count(*) AS n_readings FROM readings GROUP BY 1) r USING (station_id)
  LEFT JOIN (SELECT station_id, variable, count(*) AS n FROM sensor_faults GROUP BY 1, 2) f USING (station_id, variable)
  LEFT JOIN drifts d USING (station_id, variable) LEFT JOIN floors l USING (station_id, variable))""",
    "priority": f"""
 SELECT *, criticality * severity * data_impact AS priority0 FROM (
  SELECT h.sensor_id, h.station_id, h.variable, h.health_score, 1 / (1e0 + coalesce(g.deg, 0)) AS criticality,
   coalesce(w.sev, 0.2e0) AS severity, coalesce(i.n / CAST(max(i.n) OVER () AS DOUBLE), 0e0) AS data_impact,
   w.fault_reason
  FROM health h LEFT JOIN (SELECT station_id, count(*) AS deg FROM neigh GROUP BY 1) g USING (station_id)
  LEFT JOIN (SELECT station_id, count(*) AS n FROM readings
   WHERE t > (SELECT max(t) FROM readings) - {WEEK} GROUP BY 1) i USING (station_id)
  LEFT JOIN (SELECT station_id, variable, max(sev) AS sev, max_by(fault_type, (sev, fault_type)) AS fault_reason
   FROM (SELECT *, CASE fault_type WHEN 'dropout' THEN 1e0 WHEN 'frozen_sensor' THEN 0.9e0 WHEN 'abrupt_jump' THEN 0.8e0
     WHEN 'temperature_drift' THEN 0.7e0 WHEN 'bias' THEN 0.6e0 WHEN 'multivariate_inconsistency' THEN 0.6e0
     WHEN 'temperature_spike' THEN 0.4e0 WHEN 'noise' THEN 0.3e0 ELSE 0.2e0 END AS sev FROM sensor_faults)
   GROUP BY 1, 2) w USING (station_id, variable))""",
    "ranked": """
 SELECT *, CAST(row_number() OVER (ORDER BY priority DESC, sensor_id) AS INTEGER) AS priority_rank,
  CASE WHEN health_score < 40 THEN 'critical' WHEN health_score < 60 THEN 'high' WHEN health_score < 80 THEN 'medium'
   ELSE 'low' END AS urgency_level
 FROM (SELECT *, round(priority0 + 3e-8, 6) AS priority FROM priority)""",
}


# The decision with the stations' weekly health as a prior: the same statements over a richer vector.
CTES["weekly"] = f"""
 SELECT station_id, w * {WEEK} + {WEEK} AS t, 100e0 * (1 - avg(CASE WHEN anomaly THEN 1e0 ELSE 0e0 END)) AS health_score
 FROM (SELECT station_id, anomaly, t // {WEEK} AS w FROM flagged) GROUP BY station_id, w"""
CTES["vector_prior"] = CTES["vector"].replace(
    "p.persistence,", "greatest(p.persistence, 1 - h.health_score / 100) AS persistence,").rstrip().removesuffix(
    ")") + "\n  ASOF LEFT JOIN weekly h ON h.station_id = f.station_id AND h.t <= f.t)"
CTES["judged_prior"] = CTES["judged"].replace("FROM vector)", "FROM vector_prior)")


# The isolation forest grown by the same draws: rows thinned, dealt to trees, split level by level, then walked.
_TREES, _PSI, _LEVELS = 100, 256, 8
_X = ("a", "b", "c", "d")


def _drawn(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _chosen(of: str) -> str:
    """A column of the node's feature."""
    return "CASE feature " + " ".join(f"WHEN {i} THEN {of.format(x)}" for i, x in enumerate(_X)) + " END"


_VARY = "list_filter([" + ", ".join(f"CASE WHEN hi_{x} > lo_{x} THEN {i} END" for i, x in enumerate(_X)) + \
    "], lambda i: i IS NOT NULL)"
_RANGES = ", ".join(f"min({x}) OVER g AS lo_{x}, max({x}) OVER g AS hi_{x}" for x in _X)
_SPLIT = f"""SELECT *, {_chosen('lo_{}')} + {_drawn("'at'", "tree", "node")} / 4294967296e0 * ({_chosen('hi_{}')} - {_chosen('lo_{}')}) AS cutoff
  FROM (SELECT *, CASE WHEN level < {_LEVELS} AND len(vary) > 0 THEN vary[({_drawn("'feature'", "tree", "node")} % len(vary)) + 1]
    ELSE -1 END AS feature FROM (SELECT *, {_VARY} AS vary
     FROM (SELECT *, count(*) OVER g AS n, {_RANGES} FROM grown WINDOW g AS (PARTITION BY tree, node))))"""
CTES["scorable"] = f"""
 SELECT * FROM (SELECT reading_id, ute AS a, upr AS b, uhu AS c, CAST(hour(ts) AS DOUBLE) AS d
  FROM clean JOIN (SELECT reading_id, ts FROM readings) USING (reading_id)) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"""
CTES["forest"] = f"""
 WITH RECURSIVE size AS (SELECT count(*) AS rows, least({_PSI}, greatest(count(*), 2)) AS psi FROM scorable),
 share AS (SELECT rows, psi, least(1e0, {4 * _TREES} * psi / CAST(greatest(rows, 1) AS DOUBLE)) AS kept FROM size),
 dealt AS (SELECT s.*, tree, {_drawn("'tree'", "tree", "reading_id")} AS o
  FROM scorable s, share, range({_TREES}) AS k(tree) WHERE {_drawn("'row'", "reading_id")} < CAST(floor(kept * 4294967296e0) AS BIGINT)
   AND {_drawn("'tree'", "tree", "reading_id")} < CAST(floor(least(1e0, 1.3e0 * psi / greatest(kept * rows, 1e0)) * 4294967296e0) AS BIGINT)),
 sample AS (SELECT d.* FROM dealt d, share QUALIFY row_number() OVER (PARTITION BY tree ORDER BY o, reading_id) <= psi),
 grown AS (SELECT 0 AS level, tree, CAST(1 AS BIGINT) AS node, a, b, c, d FROM sample
  UNION ALL SELECT level + 1, tree, 2 * node + CASE WHEN {_chosen('{}')} > cutoff THEN 1 ELSE 0 END, a, b, c, d
  FROM ({_SPLIT}) WHERE feature >= 0),
 nodes AS (SELECT tree, node, any_value(feature) AS feature, any_value(cutoff) AS cutoff, any_value(CASE WHEN n > 1
   THEN level + 2 * (ln(CAST(n - 1 AS DOUBLE)) + 0.5772156649015329e0) - 2e0 * (n - 1) / n ELSE CAST(level AS DOUBLE) END) AS path
  FROM ({_SPLIT.replace("(PARTITION BY tree, node)", "(PARTITION BY level, tree, node)")}) GROUP BY tree, node),
 walk AS (SELECT reading_id, a, b, c, d, tree, CAST(1 AS BIGINT) AS node, feature, cutoff, path FROM scorable, nodes WHERE node = 1
  UNION ALL SELECT w.reading_id, w.a, w.b, w.c, w.d, w.tree, n.node, n.feature, n.cutoff, n.path
  FROM (SELECT *, 2 * node + CASE WHEN {_chosen('{}')} > cutoff THEN 1 ELSE 0 END AS child FROM walk WHERE feature >= 0) w
  JOIN nodes n ON n.tree = w.tree AND n.node = w.child)
 SELECT reading_id, pow(2e0, -avg(path) / (SELECT 2 * (ln(CAST(psi - 1 AS DOUBLE)) + 0.5772156649015329e0) - 2e0 * (psi - 1) / psi
  FROM share)) AS score FROM walk WHERE feature < 0 GROUP BY reading_id"""

# The two leading axes of the correlation matrix by power iteration, the second beside the first.
_M = [[f"r{min(i, j)}{max(i, j)}" if i != j else "1e0" for j in range(4)] for i in range(4)]


def _dot(left: list[str], right: list[str]) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(left, right)) + ")"


def _axis(name: str, minus: str | None) -> str:
    """Power iteration from a fixed vector; ``minus``: an axis to stay beside."""
    v = [f"v{i}" for i in range(4)]
    step = [_dot(_M[i], v) + (f" - {minus}.l * {minus}.v{i} * {_dot([f'{minus}.v{j}' for j in range(4)], ['p.' + x for x in v])}"
                              if minus else "") for i in range(4)]
    step = [e.replace("* v", "* p.v") for e in step]
    grown = ", ".join(f"{e} AS w{i}" for i, e in enumerate(step))
    norm = "sqrt(w0 * w0 + w1 * w1 + w2 * w2 + w3 * w3)"
    return f"""{name}_steps AS (SELECT 0 AS i, 0.9e0 AS v0, 0.5e0 AS v1, 0.3e0 AS v2, 0.7e0 AS v3, 0e0 AS l
  UNION ALL SELECT i + 1, w0 / {norm}, w1 / {norm}, w2 / {norm}, w3 / {norm}, {norm}
  FROM (SELECT p.i, {grown} FROM {name}_steps p, m{', ' + minus if minus else ''} WHERE p.i < 600)),
 {name} AS (SELECT * FROM {name}_steps WHERE i = 600)"""


CTES["reconstruction"] = f"""
 WITH RECURSIVE s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS md, stddev_samp(a) AS sa, stddev_samp(b) AS sb,
   stddev_samp(c) AS sc, stddev_samp(d) AS sd FROM scorable),
 z AS (SELECT reading_id, (a - ma) / sa AS z0, (b - mb) / sb AS z1, (c - mc) / sc AS z2, (d - md) / sd AS z3 FROM scorable, s),
 m AS (SELECT {', '.join(f'corr(z{i}, z{j}) AS r{i}{j}' for i in range(4) for j in range(i + 1, 4))} FROM z),
 {_axis('one', None)},
 {_axis('two', 'one')},
 e AS (SELECT reading_id, greatest(z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3 - pow({_dot([f'z{i}' for i in range(4)], [f'one.v{i}' for i in range(4)])}, 2)
   - pow({_dot([f'z{i}' for i in range(4)], [f'two.v{i}' for i in range(4)])}, 2), 0e0) AS error FROM z, one, two)
 SELECT reading_id, least(1e0, error / (SELECT greatest(quantile_cont(error, 0.99), 1e-12) FROM e)) AS score FROM e"""


# Readings with NaN, infinities and sentinels among their values (``fixtures.broken_readings``).
BROKEN = f"""
 SELECT * REPLACE (
  CASE WHEN seq % 50 = 7 THEN CAST('nan' AS DOUBLE) WHEN seq % 50 IN (19, 20) THEN -9999e0 ELSE temperature END AS temperature,
  CASE WHEN seq % 50 = 31 THEN CAST('inf' AS DOUBLE) WHEN seq % 50 = 33 THEN -9999e0 ELSE pressure END AS pressure,
  CASE WHEN seq % 50 = 19 THEN 150e0 WHEN seq % 50 = 41 THEN CAST('nan' AS DOUBLE) ELSE humidity END AS humidity)
 FROM ({CTES['readings']})"""


def build(sql: str, **tables: str) -> str:
    """Prefix the statement with the shared tables it needs, in dependency order; ``tables`` stand in for some."""
    used: list[str] = []
    known = CTES | tables

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", text)):
            if word in known and word not in used:
                need(known[word])
                used.append(word)

    need(sql)
    if not used:
        return sql
    return "WITH " + ", ".join(f"{name} AS ({known[name]})" for name in used) + " " + sql
