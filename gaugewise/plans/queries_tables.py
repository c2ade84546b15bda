"""Registered queries: derived tables written to their declared schema and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewise.operators import correction as co, decision as dc, health as hl
from gaugewise.plans.oracle import R, R4
from gaugewise.plans.queries_operations import _STATION_DELTA, _health, _priority, station_delta
from gaugewise.plans.registry import evaluated, naive, query, r4, r6
from gaugewise.session import fresh_path
from gaugewise.operators.impact import impact_events
from gaugewise.sources import fixtures as fx, io


def through_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Written twice by the same run, as a retried job would, then read."""
    folder = fresh_path(spark, "tables")
    io.write_table(df, name, folder)
    io.write_table(df, name, folder)
    return io.read_table(spark, name, folder)


@query("s6_anomalies", f"""SELECT reading_id, anomaly AS is_anomaly, {R('anomaly_score')} AS anomaly_score,
 'ensemble' AS model_source FROM flagged""")
def s6_anomalies(spark, sf):
    rows = evaluated(spark, sf).withColumns({"is_anomaly": F.col("anomaly"), "model_source": F.lit("ensemble")})
    return through_table(spark, rows, "anomalies").select("reading_id", "is_anomaly", r6("anomaly_score"), "model_source")


@query("s6_sensor_health", f"""SELECT sensor_id, {R4('health_score')} AS health_score, {R4('drift_rate')} AS drift_rate,
 failure_count, CAST(calibration_date AS VARCHAR) AS last_calibrated, (SELECT max(ts) FROM readings) AS updated_at FROM health""")
def s6_health(spark, sf):
    last = fx.readings(spark, sf).agg(F.max("ts").alias("t")).scalar()
    rows = through_table(spark, _health(spark, sf).withColumn("updated_at", last), "sensor_health")
    return rows.select("sensor_id", r4("health_score"), r4("drift_rate"), "failure_count", F.col("last_calibrated").cast(
        "string").alias("last_calibrated"), naive("updated_at"))


@query("s6_maintenance_queue", "SELECT sensor_id, priority_rank, urgency_level, fault_reason, 'OPEN' AS status FROM ranked")
def s6_queue(spark, sf):
    rows = through_table(spark, hl.maintenance_queue(_priority(spark, sf)), "maintenance_queue")
    return rows.select("sensor_id", "priority_rank", "urgency_level", "fault_reason", "status")


@query("s6_cascade_events", f"""SELECT impact_domain, {R('abs(delta) / threshold')} AS simulated_loss, station_id
 FROM ({_STATION_DELTA}) JOIN (VALUES ('hydrology', 2e0), ('fire_weather', 1e0), ('agriculture', 1.5e0),
 ('aviation', 0.5e0)) AS d(impact_domain, threshold) ON abs(delta) >= threshold""")
def s6_cascade(spark, sf):
    rows = through_table(spark, impact_events(station_delta(spark, sf)), "cascade_events")
    return rows.select("impact_domain", r6("simulated_loss"), F.get_json_object("details_json", "$.station_id").alias(
        "station_id"))


@query("s6_audit_log", """SELECT actor, CASE WHEN legal THEN lower(status) ELSE 'refused_' || lower(status) END AS action,
 'C-' || reading_id AS entity_id, 'event ' || event_no AS details, event_ts AS "timestamp" FROM steps""")
def s6_audit(spark, sf):
    rows = through_table(spark, co.audit_events(fx.correction_events(spark, sf)), "audit_log")
    return rows.select("actor", "action", "entity_id", "details", naive("timestamp"))


@query("s6_final_evaluations", f"""SELECT reading_id, decision, fault_type, trust_score, {R('confidence')} AS confidence,
 {R('suggested_value')} AS suggested_value FROM suggested WHERE anomaly""")
def s6_final(spark, sf):
    rows = through_table(spark, dc.final_result(evaluated(spark, sf)), "final_evaluations")
    return rows.select("reading_id", "decision", "fault_type", "trust_score", r6("confidence"), r6("suggested_value"))
