"""Declared schemas (Spark DDL) of every contract and table; nothing is inferred."""

from __future__ import annotations


WEATHER_READING = (
    "station_id string, timestamp string, temperature double, pressure double, humidity double")
READINGS = (
    "reading_id string, station_id string, ts timestamp, temperature double, pressure double, "
    "humidity double, wind_speed double, raw_payload string, quality_flag string")
FINAL_EVALUATION = (
    "reading_id string, decision string, fault_type string, trust_score int, confidence double, "
    "suggested_value double, explanation array<string>")
STATIONS = (
    "id string, station_code string, name string, latitude double, longitude double, "
    "elevation double, status string, created_at timestamp")
SENSORS = (
    "id string, station_id string, sensor_type string, model string, install_date date, "
    "calibration_date date, status string")
TABLES: dict[str, str] = {
    "anomalies": (
        "reading_id string, is_anomaly boolean, anomaly_score double, model_source string, "
        "signals_json string, created_at timestamp"),
    "corrections": (
        "id string, reading_id string, original_value double, suggested_value double, "
        "status string, reviewed_by string, reviewed_at timestamp"),
    "sensor_health": (
        "sensor_id string, health_score double, drift_rate double, failure_count bigint, "
        "last_calibrated date, updated_at timestamp"),
    "maintenance_queue": (
        "sensor_id string, priority_rank int, urgency_level string, fault_reason string, "
        "status string, assigned_to string"),
    "cascade_events": (
        "reading_id string, impact_domain string, simulated_loss double, severity string, "
        "details_json string"),
    "audit_log": (
        "actor string, action string, entity_type string, entity_id string, details string, "
        "timestamp timestamp"),
    "final_evaluations": FINAL_EVALUATION,
}
