"""Registered queries: corrections, audit, sensor health, maintenance, impact and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewise.config import DEFAULT, VARIABLES
from gaugewise.operators import correction as co, health as hl, impact as im, stations as st
from gaugewise.plans.oracle import R, R4
from gaugewise.plans.registry import evaluated, judged, naive, query, r4, r6, stage
from gaugewise.sources import fixtures as fx


@query("c1_interpolate", f"SELECT reading_id, variable, {R('interpolated')} AS interpolated FROM interp")
def c1(spark, sf):
    out = co.with_interpolation(judged(spark, sf).select("reading_id", "station_id", "t", "anomaly", *VARIABLES))
    return out.withColumnsRenamed({f"interp_{v}": f"_{v}" for v in VARIABLES}).drop(*VARIABLES).withColumnsRenamed(
        {f"_{v}": v for v in VARIABLES}).unpivot(["reading_id"], list(VARIABLES), "variable", "interpolated").select(
        "reading_id", "variable", r6("interpolated"))


@query("c2_consensus_value", f"SELECT reading_id, focus AS variable, {R('idw')} AS consensus FROM judged WHERE anomaly")
def c2(spark, sf):
    return judged(spark, sf).where("anomaly").select(
        "reading_id", F.col("focus").alias("variable"), r6("idw", "consensus"))


@query("c3_suggest", f"""SELECT reading_id, suggested_variable, {R('suggested_value')} AS suggested_value
 FROM suggested WHERE anomaly""")
def c3(spark, sf):
    base = judged(spark, sf)
    interp = co.with_interpolation(base.select("reading_id", "station_id", "t", "anomaly", *VARIABLES))
    joined = base.where("anomaly").join(
        interp.where("anomaly").select("reading_id", *[f"interp_{v}" for v in VARIABLES]), "reading_id")
    return co.suggest(joined).select("reading_id", "suggested_variable", r6("suggested_value"))


@query("c4_correction_records", f"""SELECT 'C-' || reading_id AS id, reading_id, {R('x')} AS original_value,
 {R('suggested_value')} AS suggested_value, 'SUGGESTED' AS status FROM suggested WHERE suggested_value IS NOT NULL""")
def c4(spark, sf):
    return co.corrections(evaluated(spark, sf)).select(
        "id", "reading_id", r6("original_value"), r6("suggested_value"), "status")


@query("c5_correction_status", "SELECT reading_id, status, reviewed_at, reviewed_by, n_events, n_illegal FROM status")
def c5(spark, sf):
    return co.correction_status(fx.correction_events(spark, sf)).select(
        "reading_id", "status", naive("reviewed_at"), "reviewed_by", "n_events", "n_illegal")


@query("c5_illegal_steps", "SELECT reading_id, event_no, status FROM steps WHERE NOT legal")
def c5b(spark, sf):
    return co.legal_steps(fx.correction_events(spark, sf)).where(~F.col("legal")).select(
        "reading_id", "event_no", "status")


@query("c6_corrected_view", f"""SELECT reading_id, {R('temperature')} AS temperature, {R('corrected_temperature')}
 AS corrected_temperature, {R('corrected_pressure')} AS corrected_pressure, {R('corrected_humidity')}
 AS corrected_humidity FROM corrected""")
def c6(spark, sf):
    return _corrected(spark, sf).select(
        "reading_id", r6("temperature"), *[r6(f"corrected_{v}") for v in VARIABLES])


def _corrected(spark, sf):
    return co.corrected_view(
        fx.readings(spark, sf), evaluated(spark, sf).where("suggested_value is not null"),
        co.correction_status(fx.correction_events(spark, sf)))


@query("c7_audit_events", """SELECT actor, CASE WHEN legal THEN lower(status) ELSE 'refused_' || lower(status) END AS action,
 'correction' AS entity_type, 'C-' || reading_id AS entity_id, 'event ' || event_no AS details, event_ts AS "timestamp" FROM steps""")
def c7(spark, sf):
    return co.audit_events(fx.correction_events(spark, sf)).select(
        "actor", "action", "entity_type", "entity_id", "details", naive("timestamp"))


@query("c7_unaudited", "SELECT event_no, reading_id FROM correction_events WHERE event_no % 10 = 0")
def c7b(spark, sf):
    events = fx.correction_events(spark, sf)
    return co.unaudited(events, co.audit_events(events.where("event_no % 10 <> 0"))).select("event_no", "reading_id")


@query("h1_drift_profile", f"""SELECT station_id, variable, n, {R4('drift_rate')} AS drift_rate,
 {R4('cumulative_drift')} AS cumulative_drift FROM drifts""")
def h1(spark, sf):
    return hl.drift_profile(hl.residuals(judged(spark, sf))).select(
        "station_id", "variable", "n", r4("drift_rate"), r4("cumulative_drift"))


_KINDS = ("temperature_spike", "temperature_drift", "frozen_sensor", "dropout", "abrupt_jump", "bias", "noise",
          "multivariate_inconsistency", "unclassified")


@query("h2_failure_counts", "SELECT station_id, variable, " + ", ".join(
    f"count(*) FILTER (WHERE fault_type = '{k}') AS {k}" for k in _KINDS)
    + ", count(*) AS failure_count FROM sensor_faults GROUP BY station_id, variable")
def h2(spark, sf):
    return hl.failure_counts(evaluated(spark, sf))


@query("h2_failure_rollup", """SELECT sensor_id, fault_type, count(*) AS n_faults FROM
 (SELECT station_id || ':' || variable AS sensor_id, fault_type FROM sensor_faults) GROUP BY ROLLUP (sensor_id, fault_type)""")
def h2b(spark, sf):
    return hl.failure_rollup(evaluated(spark, sf))


@query("h3_noise_floor", f"SELECT station_id, variable, {R('noise_floor')} AS noise_floor FROM floors")
def h3(spark, sf):
    return hl.noise_floor(judged(spark, sf)).select("station_id", "variable", r6("noise_floor"))


@query("h4_degradation", f"""SELECT station_id, week, n, n_faults, {R('health')} AS health,
 {R('health - lag(health) OVER (PARTITION BY station_id ORDER BY week)')} AS change FROM (
 SELECT station_id, date_trunc('week', ts) AS week, count(*) AS n, count(*) FILTER (WHERE decision = 'sensor_fault') AS n_faults,
  100 * (1 - count(*) FILTER (WHERE decision = 'sensor_fault') / CAST(count(*) AS DOUBLE)) AS health
 FROM judged GROUP BY 1, 2)""")
def h4(spark, sf):
    return hl.degradation(judged(spark, sf)).select(
        "station_id", naive("week"), "n", "n_faults", r6("health"), r6("change"))


@query("h5_calibration_age", """SELECT sensor_id, CAST(date_diff('day', calibration_date, DATE '2024-01-30') AS INTEGER) AS age_days
 FROM sensors""")
def h5(spark, sf):
    return hl.calibration_age(fx.sensors(spark, sf), F.lit("2024-01-30").cast("date")).select("sensor_id", "age_days")


def _health(spark, sf):
    def make():
        as_of = fx.readings(spark, sf).agg(F.to_date(F.max("ts")).alias("as_of")).scalar()
        return hl.sensor_health(evaluated(spark, sf), fx.sensors(spark, sf), as_of)
    return stage(spark, sf, "health", make)


@query("h6_sensor_health", f"""SELECT sensor_id, {R4('health_score')} AS health_score, {R4('drift_rate')} AS drift_rate,
 {R('noise_floor')} AS noise_floor, failure_count, CAST(age_days AS INTEGER) AS age_days FROM health""")
def h6(spark, sf):
    return _health(spark, sf).select("sensor_id", r4("health_score"), r4("drift_rate"), r6("noise_floor"),
                                     "failure_count", "age_days")


def _priority(spark, sf):
    edges = st.neighbours(fx.stations(spark, sf), DEFAULT.radius_km)
    p = hl.maintenance_priority(_health(spark, sf), evaluated(spark, sf), edges)
    # Two engines agree on a rank only if priorities that differ in the last bits are one priority.
    return p.withColumn("priority", F.round(F.col("priority") + 3e-8, 6))


@query("m1_maintenance_priority", f"""SELECT sensor_id, {R('criticality')} AS criticality, {R('severity')} AS severity,
 {R('data_impact')} AS data_impact, fault_reason, {R('priority0')} AS priority FROM priority""")
def m1(spark, sf):
    return _priority(spark, sf).select(
        "sensor_id", r6("criticality"), r6("severity"), r6("data_impact"), "fault_reason", r6("priority"))


@query("m2_maintenance_queue", """SELECT sensor_id, priority_rank, urgency_level, fault_reason, priority, 'OPEN' AS status
 FROM ranked""")
def m2(spark, sf):
    return hl.maintenance_queue(_priority(spark, sf)).select(
        "sensor_id", "priority_rank", "urgency_level", "fault_reason", "priority", "status")


@query("m3_top_maintenance", "SELECT sensor_id, priority_rank FROM ranked ORDER BY priority_rank LIMIT 20")
def m3(spark, sf):
    return hl.top_maintenance(hl.maintenance_queue(_priority(spark, sf)), 20).select("sensor_id", "priority_rank")


@query("m3_top_by_region", """SELECT region, sensor_id, CAST(rn AS INTEGER) AS region_rank FROM (SELECT s.region, r.sensor_id,
 row_number() OVER (PARTITION BY s.region ORDER BY r.priority_rank) AS rn FROM ranked r JOIN stations s USING (station_id))
 WHERE rn <= 5""")
def m3b(spark, sf):
    return hl.top_maintenance(hl.maintenance_queue(_priority(spark, sf)), 5, fx.stations(spark, sf)).select(
        "region", "sensor_id", "region_rank")


_DELTA = """SELECT region, strftime(ts, '%Y-%m-%d') AS day, avg(temperature) AS raw, avg(corrected_temperature) AS corrected,
 avg(temperature) - avg(corrected_temperature) AS delta FROM corrected JOIN stations USING (station_id) GROUP BY 1, 2"""


def _delta(spark, sf):
    st_region = fx.stations(spark, sf).select("station_id", "region")
    view = _corrected(spark, sf).join(st_region, "station_id").withColumn(
        "day", F.date_format("ts", "yyyy-MM-dd"))
    raw = view.select("region", "day", "temperature")
    fixed = view.select("region", "day", F.col("corrected_temperature").alias("temperature"))
    return im.impact_delta(raw, fixed, ["region", "day"], F.col("temperature"))


@query("i1_impact_delta", f"SELECT region, day, {R('raw')} AS raw, {R('corrected')} AS corrected, {R('delta')} AS delta FROM ({_DELTA})")
def i1(spark, sf):
    return _delta(spark, sf).select("region", "day", r6("raw"), r6("corrected"), r6("delta"))


_STATION_DELTA = """SELECT station_id, strftime(ts, '%Y-%m-%d') AS day, avg(temperature) - avg(corrected_temperature) AS delta
 FROM corrected GROUP BY 1, 2"""


def station_delta(spark, sf):
    view = _corrected(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return im.impact_delta(view.select("station_id", "day", "temperature"), view.select(
        "station_id", "day", F.col("corrected_temperature").alias("temperature")),
        ["station_id", "day"], F.col("temperature"))


@query("i2_impact_events", f"""SELECT station_id, day, impact_domain, {R('abs(delta) / threshold')} AS simulated_loss,
 CASE WHEN abs(delta) >= 5 THEN 'severe' WHEN abs(delta) >= 2 THEN 'moderate' WHEN abs(delta) >= 1 THEN 'minor' ELSE 'none' END
 AS severity FROM ({_STATION_DELTA}) JOIN (VALUES ('hydrology', 2e0), ('fire_weather', 1e0), ('agriculture', 1.5e0),
 ('aviation', 0.5e0)) AS d(impact_domain, threshold) ON abs(delta) >= threshold""")
def i2(spark, sf):
    return im.impact_events(station_delta(spark, sf)).select("station_id", "day", "impact_domain", r6("simulated_loss"), "severity")


@query("i3_exposure", f"""SELECT station_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n,
 count(*) FILTER (WHERE trust_score < 50) AS n_low_trust, {R('count(*) FILTER (WHERE trust_score < 50) / CAST(count(*) AS DOUBLE)')}
 AS low_trust_share FROM judged GROUP BY 1, 2""")
def i3(spark, sf):
    day = judged(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return im.exposure(day, ["station_id", "day"]).select(
        "station_id", "day", "n", "n_low_trust", r6("low_trust_share"))


@query("b1_downsample", f"""SELECT station_id, date_trunc('day', ts) AS start_ts, count(*) AS n, {R('avg(temperature)')} AS mean_temperature,
 {R('min(temperature)')} AS min_temperature, {R('max(temperature)')} AS max_temperature, {R('avg(pressure)')} AS mean_pressure,
 {R('avg(humidity)')} AS mean_humidity FROM readings GROUP BY 1, 2""")
def b1(spark, sf):
    return im.downsample(fx.readings(spark, sf)).select("station_id", naive("start_ts"), "n", *map(r6, (
        "mean_temperature", "min_temperature", "max_temperature", "mean_pressure", "mean_humidity")))


@query("b2_station_comparison", f"""SELECT station_id, count(x - idw) AS n_temperature, {R('avg(x - idw)')} AS bias_temperature,
 {R('avg(abs(x - idw))')} AS mad_temperature FROM idw WHERE variable = 'temperature' GROUP BY station_id""")
def b2(spark, sf):
    return im.station_comparison(judged(spark, sf)).select(
        "station_id", "n_temperature", r6("bias_temperature"), r6("mad_temperature"))


@query("b3_trust_distribution", """SELECT CAST(least(floor(trust_score / 10), 9) AS INTEGER) AS trust_bin, count(*) AS n
 FROM judged WHERE decision IS NOT NULL GROUP BY 1""")
def b3(spark, sf):
    return im.trust_distribution(judged(spark, sf))


@query("b3_decision_counts", """SELECT station_id, strftime(ts, '%Y-%m-%d') AS day,
 count(*) FILTER (WHERE decision = 'genuine_weather') AS genuine_weather,
 count(*) FILTER (WHERE decision = 'sensor_fault') AS sensor_fault, count(*) FILTER (WHERE decision = 'uncertain') AS uncertain
 FROM judged WHERE decision IS NOT NULL GROUP BY 1, 2""")
def b3b(spark, sf):
    return im.decision_counts(judged(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("b4_health_feed", f"""SELECT h.sensor_id, {R4('h.health_score')} AS health_score, s.region, {R('s.latitude')} AS latitude,
 {R('s.longitude')} AS longitude FROM health h JOIN stations s USING (station_id)""")
def b4(spark, sf):
    return im.health_feed(_health(spark, sf), fx.stations(spark, sf)).select(
        "sensor_id", r4("health_score"), "region", r6("latitude"), r6("longitude"))


@query("b4_queue_feed", f"""SELECT r.sensor_id, r.priority_rank, r.urgency_level, s.region, {R('s.latitude')} AS latitude
 FROM ranked r JOIN stations s USING (station_id)""")
def b4b(spark, sf):
    return im.queue_feed(hl.maintenance_queue(_priority(spark, sf)), fx.stations(spark, sf)).select(
        "sensor_id", "priority_rank", "urgency_level", "region", r6("latitude"))
