"""Registered queries: evidence, decision, trust, faults and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewise.config import DEFAULT, VARIABLES
from gaugewise.operators import decision as dc, evidence as ev, faults as fl, features as ft, stations as st
from gaugewise.plans import evaluate
from gaugewise.plans.oracle import BROKEN, R, R4, WEEK, whole
from gaugewise.plans.registry import evaluated, judged, query, r4, r6, stage
from gaugewise.sources import fixtures as fx


@query("e1_rate_of_change", f"SELECT reading_id, variable, gap_us, {R('rate')} AS rate FROM adj")
def e1(spark, sf):
    return ev.rate_of_change(fx.readings(spark, sf)).select("reading_id", "variable", "gap_us", r6("rate"))


@query("e2_rate_violation", f"""SELECT reading_id, variable, {R('rate')} AS rate FROM adj WHERE abs(rate) >
 CASE variable WHEN 'temperature' THEN 10 WHEN 'pressure' THEN 5 ELSE 30 END""")
def e2(spark, sf):
    return ev.rate_violation(fx.readings(spark, sf)).select("reading_id", "variable", r6("rate"))


@query("e3_trend", f"""SELECT reading_id, variable, {R4('slope')} AS slope, {R4('x - predicted')} AS residual FROM fit""")
def e3(spark, sf):
    return ft.trend(fx.readings(spark, sf)).select("reading_id", "variable", r4("slope"), r4("residual"))


@query("e4_diurnal", f"""SELECT o.reading_id, o.variable, d.dn AS n, {R('d.dmean')} AS mean, {R('d.dstd')} AS std,
 {R('o.x - d.dmean')} AS deviation FROM obs o JOIN daily d ON d.station_id = o.station_id AND d.variable = o.variable
 AND d.hour = hour(o.ts)""")
def e4(spark, sf):
    wide = ft.with_diurnal(fx.readings(spark, sf))
    return ft.per_variable(wide, {v: {
        "n": F.col(f"dn_{v}"), "mean": r6(f"dmean_{v}"), "std": r6(f"dstd_{v}"),
        "deviation": r6(F.col(v) - F.col(f"dmean_{v}"))} for v in VARIABLES}, ["reading_id"])


@query("e5_temporal_evidence", f"""SELECT reading_id, variable, {R('rate_excess')} AS rate_excess,
 {R('temporal')} AS temporal FROM temporal""")
def e5(spark, sf):
    return ev.temporal_evidence(fx.readings(spark, sf)).select(
        "reading_id", "variable", r6("rate_excess"), r6("temporal"))


@query("e6_t_rh_consistency", f"""SELECT reading_id, {R('dew_point')} AS dew_point, dew_term, {R('t_rh')} AS t_rh
 FROM sensor_terms""")
def e6(spark, sf):
    return ev.t_rh_consistency(fx.readings(spark, sf)).select(
        "reading_id", r6("dew_point"), "dew_term", r6("t_rh"))


@query("e7_p_wind_consistency", f"""SELECT reading_id, {R('''CASE WHEN d_p IS NULL OR d_w IS NULL THEN NULL WHEN d_p > -3
 THEN 1e0 ELSE least(1e0, greatest(0e0, d_w / (2 * abs(d_p)))) END''')} AS p_wind FROM sensor_terms""")
def e7(spark, sf):
    wind = fx.readings(spark, sf).withColumn("wind_speed", 2.0 * (F.col("seq") % 11))
    return ev.p_wind_consistency(wind).select("reading_id", r6("p_wind"))


@query("e8_rolling_corr", f"""SELECT reading_id, {R('corr_temperature_pressure')} AS corr_temperature_pressure,
 {R('corr_temperature_humidity')} AS corr_temperature_humidity, {R('corr_pressure_humidity')} AS corr_pressure_humidity
 FROM pairs""")
def e8(spark, sf):
    return ft.rolling_corr(fx.readings(spark, sf)).select(
        "reading_id", *[r6(f"corr_{a}_{b}") for a, b in ft.PAIRS])


@query("e9_cross_sensor", f"""SELECT reading_id, {R('corr_term')} AS corr_term, {R('cross_sensor')} AS cross_sensor
 FROM sensor_ev""")
def e9(spark, sf):
    return ev.cross_sensor_evidence(fx.readings(spark, sf)).select(
        "reading_id", r6("corr_term"), r6("cross_sensor"))


@query("e10_neighbours", f"SELECT station_id, neighbour_id, {R('km')} AS km FROM neigh")
def e10(spark, sf):
    return st.neighbours(fx.stations(spark, sf), DEFAULT.radius_km).select("station_id", "neighbour_id", r6("km"))


@query("e10_neighbours_wrap", f"""SELECT station_id, neighbour_id, {R('km')} AS km FROM (
 SELECT a.station_id, b.station_id AS neighbour_id, 12742e0 * asin(sqrt(least(1e0,
  pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude))
  * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
 FROM (SELECT *, CASE WHEN longitude + 109.9e0 > 180 THEN longitude - 250.1e0 ELSE longitude + 109.9e0 END AS lon FROM stations) a
 JOIN (SELECT *, CASE WHEN longitude + 109.9e0 > 180 THEN longitude - 250.1e0 ELSE longitude + 109.9e0 END AS lon FROM stations) b
  ON a.station_id <> b.station_id) WHERE km <= 30""")
def e10_wrap(spark, sf):
    """The same stations moved onto the date line."""
    east = F.col("longitude") + 109.9
    moved = fx.stations(spark, sf).withColumn("longitude", F.when(east > 180, F.col("longitude") - 250.1).otherwise(east))
    return st.neighbours(moved, DEFAULT.radius_km).select("station_id", "neighbour_id", r6("km"))


def _edges(spark, sf):
    return st.neighbours(fx.stations(spark, sf), DEFAULT.radius_km)


_ALIGN = f"""SELECT reading_id, neighbour_id, count(*) FILTER (WHERE variable = 'temperature') AS n_temperature,
 {R("avg(x) FILTER (WHERE variable = 'temperature')")} AS mean_temperature, {R("avg(x) FILTER (WHERE variable = 'pressure')")}
 AS mean_pressure, {R("avg(x) FILTER (WHERE variable = 'humidity')")} AS mean_humidity
 FROM aligned GROUP BY reading_id, neighbour_id"""


def _align(rows, spark, sf):
    return st.aligned_view(rows, None, stations=fx.stations(spark, sf)).select(
        "reading_id", "neighbour_id", "n_temperature", *[r6(f"mean_{v}") for v in VARIABLES])


@query("e11_align_neighbours", _ALIGN)
def e11(spark, sf):
    return _align(fx.readings(spark, sf), spark, sf)


@query("e11_align_broken", _ALIGN, readings=BROKEN)
def e11_broken(spark, sf):
    return _align(fx.broken_readings(spark, sf), spark, sf)


@query("e11_nearest_neighbours", f"""SELECT reading_id, neighbours, {R('nearest_km')} AS nearest_km FROM (
 SELECT reading_id, count(DISTINCT neighbour_id) AS neighbours, min(km) AS nearest_km FROM nearest GROUP BY reading_id)""")
def e11c(spark, sf):
    near = st.nearest_neighbours(fx.readings(spark, sf), None, stations=fx.stations(spark, sf))
    return near.groupBy("reading_id").agg(F.count(F.lit(1)).alias("neighbours"), r6(F.min("km"), "nearest_km"))


_ASOF = f"""SELECT e.reading_id, e.neighbour_id, n.reading_id AS neighbour_reading_id, e.t - n.t AS age_us,
 {R('n.ute')} AS neighbour_temperature, {R('n.upr')} AS neighbour_pressure, {R('n.uhu')} AS neighbour_humidity
 FROM (SELECT r.*, s.neighbour_id FROM clean r JOIN neigh s USING (station_id)) e
 ASOF JOIN (SELECT * FROM clean WHERE coalesce(ute, upr, uhu) IS NOT NULL) n ON n.station_id = e.neighbour_id AND n.t <= e.t
 WHERE e.t - n.t <= 10800000000"""


def _asof(rows, spark, sf):
    return st.asof_neighbours(rows, _edges(spark, sf)).select(
        "reading_id", "neighbour_id", "neighbour_reading_id", "age_us", *[r6(f"neighbour_{v}") for v in VARIABLES])


@query("e11_asof_neighbours", _ASOF)
def e11b(spark, sf):
    return _asof(fx.readings(spark, sf), spark, sf)


@query("e11_asof_broken", _ASOF, readings=BROKEN)
def e11b_broken(spark, sf):
    """As above where a tenth of the values are NaN, infinite or sentinels."""
    return _asof(fx.broken_readings(spark, sf), spark, sf)


_IDW = f"""SELECT reading_id, variable, {R('idw')} AS idw, nn AS n_neighbours, agree AS n_agree,
 {R('spread')} AS spread, {R('cross_station')} AS cross_station FROM idw"""


def _idw(rows, spark, sf):
    return st.idw_consensus(rows, fx.stations(spark, sf)).select(
        "reading_id", "variable", r6("idw"), "n_neighbours", "n_agree", r6("spread"), r6("cross_station"))


@query("e12_idw_consensus", _IDW)
def e12(spark, sf):
    return _idw(fx.readings(spark, sf), spark, sf)


@query("e12_idw_broken", _IDW, readings=BROKEN)
def e12_broken(spark, sf):
    return _idw(fx.broken_readings(spark, sf), spark, sf)


@query("e13_persistence", f"""SELECT f.reading_id, {R('p.persistence')} AS persistence, CAST(run AS BIGINT) AS flag_run FROM (
  SELECT *, n - coalesce(max(CASE WHEN NOT anomaly THEN n END) OVER (PARTITION BY station_id ORDER BY n), 0) AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY t, reading_id) AS n FROM flagged)) f
 JOIN persist p USING (reading_id)""")
def e13(spark, sf):
    base = judged(spark, sf).select("reading_id", "station_id", "t", "anomaly")
    return ev.with_flag_run(ev.with_persistence(base, source=base)).select(
        "reading_id", r6("persistence"), "flag_run")


def _weekly(base):
    """Health known at the end of each week: the share of its readings that were not flagged."""
    return base.groupBy("station_id", F.floor(F.col("t") / WEEK).cast("long").alias("w")).agg(
        (100 * (1 - F.avg(F.col("anomaly").cast("double")))).alias("health_score")).select(
        "station_id", ((F.col("w") + 1) * WEEK).alias("t"), "health_score")


@query("e14_health_prior", f"""SELECT f.reading_id, {R('h.health_score')} AS prior_health, h.t AS health_t
 FROM flagged f ASOF LEFT JOIN weekly h ON h.station_id = f.station_id AND h.t <= f.t""")
def e14(spark, sf):
    base = judged(spark, sf).select("reading_id", "station_id", "t", "anomaly")
    return ev.health_prior(base, _weekly(base)).select("reading_id", r6("prior_health"), "health_t")


@query("e14_health_decision", f"""SELECT reading_id, {R('persistence')} AS persistence, decision, trust_score
 FROM judged_prior""")
def e14_decision(spark, sf):
    """Decisions once the weekly health counts as evidence."""
    base = judged(spark, sf)
    return evaluate.judge(base, health=_weekly(base)).select("reading_id", r6("persistence"), "decision", "trust_score")


@query("e15_evidence_vector", f"""SELECT reading_id, focus, {R('temporal')} AS temporal, {R('cross_sensor')} AS cross_sensor,
 {R('cross_station')} AS cross_station, {R('persistence')} AS persistence, {R('coverage')} AS coverage,
 {R('conflict')} AS conflict FROM judged""")
def e15(spark, sf):
    return judged(spark, sf).select(
        "reading_id", "focus", *[r6(F.col(f"evidence.{n}"), n) for n in DEFAULT.weights],
        r6("coverage"), r6("conflict"))


@query("r1_genuineness", f"SELECT reading_id, {R('g')} AS g FROM judged")
def r1(spark, sf):
    base = judged(spark, sf).drop("g", "coverage", "conflict", "evidence")
    return dc.with_genuineness(ev.evidence_vector(base)).select("reading_id", r6("g"))


@query("r2_decide", "SELECT reading_id, decision FROM judged WHERE anomaly")
def r2(spark, sf):
    base = judged(spark, sf).drop("decision")
    return dc.decide(base).where("anomaly").select("reading_id", "decision")


@query("r3_confidence", f"SELECT reading_id, {R('confidence')} AS confidence FROM judged WHERE anomaly")
def r3(spark, sf):
    return dc.confidence(judged(spark, sf).drop("confidence")).where("anomaly").select(
        "reading_id", r6("confidence"))


@query("r4_evidence_support", f"""SELECT reading_id, {R("CASE WHEN decision = 'sensor_fault' THEN 1 - temporal ELSE temporal END")}
 AS support_temporal, {R("CASE WHEN decision = 'sensor_fault' THEN 1 - cross_station ELSE cross_station END")} AS support_cross_station,
 {R("CASE WHEN decision = 'sensor_fault' THEN persistence ELSE 1 - persistence END")} AS support_persistence
 FROM judged WHERE anomaly""")
def r4_support(spark, sf):
    return dc.evidence_support(judged(spark, sf).where("anomaly")).select(
        "reading_id", *map(r6, ("support_temporal", "support_cross_station", "support_persistence")))


@query("t1_trust_score", "SELECT reading_id, trust_score FROM judged")
def t1(spark, sf):
    return dc.with_trust(judged(spark, sf).drop("trust_score")).select("reading_id", "trust_score")


@query("t1_trust_broken", f"""SELECT reading_id, anomaly, decision, fault_type, trust_score, {R('confidence')} AS confidence
 FROM faults""", readings=BROKEN)
def t1_broken(spark, sf):
    """Whole decisions where a tenth of the values are NaN, infinite or sentinels."""
    base = stage(spark, sf, "broken", lambda: evaluate.evaluated(fx.broken_readings(spark, sf), fx.stations(spark, sf)))
    return base.select("reading_id", "anomaly", "decision", "fault_type", "trust_score", r6("confidence"))


@query("t2_trusted", "SELECT reading_id, trust_score FROM judged WHERE trust_score >= 80")
def t2(spark, sf):
    return dc.trusted(judged(spark, sf), 80).select("reading_id", "trust_score")


@query("x0_classify_fault", """SELECT reading_id, fault_type, CASE WHEN archetype IS NOT NULL THEN focus END AS variable,
 archetype FROM faults WHERE anomaly""")
def x0(spark, sf):
    return evaluated(spark, sf).where("anomaly").select(
        "reading_id", "fault_type", "fault_detail.variable", "fault_detail.archetype")


@query("x1_spike", "SELECT reading_id, variable, is_spike FROM spikes")
def x1(spark, sf):
    return fl.adjacent_flags(fx.readings(spark, sf), "spike").select("reading_id", "variable", "is_spike")


@query("x2_dropout", "SELECT reading_id, variable, is_dropout FROM dropouts")
def x2(spark, sf):
    return fl.dropout_flags(fx.readings(spark, sf)).select("reading_id", "variable", "is_dropout")


@query("x3_frozen", "SELECT reading_id, variable, run_length, run_length >= 5 AS is_frozen FROM runs")
def x3(spark, sf):
    return fl.frozen_flags(fx.readings(spark, sf)).select("reading_id", "variable", "run_length", "is_frozen")


@query("x4_abrupt_jump", "SELECT reading_id, variable, is_jump FROM jumps")
def x4(spark, sf):
    return fl.adjacent_flags(fx.readings(spark, sf), "jump").select("reading_id", "variable", "is_jump")


def _resid(spark, sf):
    base = judged(spark, sf).select("reading_id", "station_id", "t", *VARIABLES, *[
        f"{p}_{v}" for v in VARIABLES for p in ("idw", "n", "std")])
    return fl.residual_flags(base)


@query("x5_drift", f"SELECT reading_id, variable, {R4('slope')} AS slope, is_drift FROM resid")
def x5(spark, sf):
    return _resid(spark, sf).select("reading_id", "variable", r4("slope"), "is_drift")


@query("x6_bias", "SELECT reading_id, variable, is_bias FROM resid")
def x6(spark, sf):
    return _resid(spark, sf).select("reading_id", "variable", "is_bias")


@query("x7_noise", f"SELECT reading_id, variable, {R('noise_level')} AS noise_level, is_noise FROM resid")
def x7(spark, sf):
    return _resid(spark, sf).select("reading_id", "variable", r6("noise_level"), "is_noise")


@query("x8_inconsistency", """SELECT reading_id, coalesce(cross_sensor < 0.3 AND (temporal IS NULL OR temporal >= 0.7), false)
 AS is_inconsistent FROM judged""")
def x8(spark, sf):
    return judged(spark, sf).select(
        "reading_id", fl.inconsistent(F.col("temporal"), DEFAULT).alias("is_inconsistent"))


_LABEL = "upper(focus[1]) || focus[2:]"
_EXPLAINED = f"""SELECT reading_id, concat_ws(' | ',
 CASE WHEN x IS NULL AND missing_run THEN {_LABEL} || ' is missing in consecutive readings' END,
 CASE WHEN x IS NULL AND NOT missing_run THEN {_LABEL} || ' is missing' END,
 CASE WHEN x IS NOT NULL THEN {_LABEL} || ' has anomaly score ' || {whole('anomaly_score * 100')} || '/100' END,
 CASE WHEN impossible THEN {_LABEL} || ' is outside its physical limits' END,
 CASE WHEN temporal < 0.35 THEN {_LABEL} || ' changed faster than expected' END,
 CASE WHEN temporal >= 0.65 THEN {_LABEL} || ' changed at a plausible rate' END,
 CASE WHEN cross_station < 0.35 THEN 'Nearby stations disagree: consensus around ' || {whole('idw')} || ' from ' || nn || ' stations' END,
 CASE WHEN cross_station >= 0.65 THEN agree || ' of ' || nn || ' nearby stations agree' END,
 CASE WHEN cross_station IS NULL THEN 'Too few nearby stations to compare' END,
 CASE WHEN cross_sensor < 0.35 THEN 'Other sensors of the station did not support the change' END,
 CASE WHEN cross_sensor >= 0.65 THEN 'Other sensors of the station are consistent' END,
 CASE WHEN persistence >= 0.5 THEN 'The station was flagged repeatedly in the last day' END,
 CASE WHEN fault_type IS NOT NULL THEN 'Signature matches ' || fault_type END,
 CASE WHEN decision = 'uncertain' THEN 'Evidence is insufficient or conflicting; review needed' END) AS explanation"""


@query("n1_explain", f"{_EXPLAINED} FROM suggested WHERE anomaly")
def n1(spark, sf):
    return dc.explain(evaluated(spark, sf).where("anomaly")).select(
        "reading_id", F.concat_ws(" | ", "explanation").alias("explanation"))


_FINAL = f"""{_EXPLAINED}, decision, fault_type, trust_score, {R('confidence')} AS confidence,
 {R('suggested_value')} AS suggested_value FROM suggested WHERE anomaly"""


def _final(d):
    return d.select("reading_id", "decision", "fault_type", "trust_score", r6("confidence"),
                    r6("suggested_value"), F.concat_ws(" | ", "explanation").alias("explanation"))


@query("n2_final_result", _FINAL)
def n2(spark, sf):
    return _final(dc.final_result(evaluated(spark, sf)))


@query("n2_least_trusted", f"{_FINAL} ORDER BY trust_score, reading_id LIMIT 100")
def n2b(spark, sf):
    return _final(dc.final_result(evaluated(spark, sf)).orderBy("trust_score", "reading_id").limit(100))
