"""Registered queries: sources, sinks, validation and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewise.config import VARIABLES
from gaugewise.operators import quality as q
from gaugewise.plans.oracle import R
from gaugewise.plans.registry import evaluated, naive, query, r6
from gaugewise.session import fresh_path
from gaugewise.sources import fixtures as fx, io


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with the usual ingestion defects: lost or unknown station, impossible values, copies."""
    seq = F.col("seq")
    base = fx.readings(spark, sf).select(
        "reading_id", F.when(seq % 97 == 0, F.lit(None)).when(seq % 83 == 0, "AWS-UNKNOWN")
        .otherwise(F.col("station_id")).alias("station_id"), "ts", "t",
        F.when(seq % 89 == 0, F.col("temperature") + 100).otherwise(F.col("temperature")).alias("temperature"),
        "pressure", F.when(seq % 50 == 0, F.col("humidity") + 60).when(seq % 50 == 1, F.col("humidity") - 100)
        .otherwise(F.col("humidity")).alias("humidity"), "seq")
    copies = base.where(seq % 50 == 3).withColumn("reading_id", F.concat("reading_id", F.lit("-dup")))
    return base.unionByName(copies)


@query("s1_read_readings", f"SELECT reading_id, station_id, ts, {R('temperature')} AS temperature, "
       f"{R('pressure')} AS pressure, {R('humidity')} AS humidity FROM readings")
def s1(spark, sf):
    path = fresh_path(spark, "s1")
    fx.readings(spark, sf).drop("seq", "k", "t", "truth").write.parquet(path)
    return io.read_readings(spark, path).select("reading_id", "station_id", naive("ts"), *map(r6, VARIABLES))


@query("s1_read_payloads", f"SELECT station_id, ts, t, {R('temperature')} AS temperature, "
       f"{R('pressure')} AS pressure, {R('humidity')} AS humidity FROM readings")
def s1_json(spark, sf):
    """Contract rows as JSON text, back as readings with key and time."""
    path = fresh_path(spark, "s1")
    fx.readings(spark, sf).select(io.payload_json().alias("value")).write.text(path)
    return io.read_payloads(spark, path).select("station_id", naive("ts"), "t", *map(r6, VARIABLES))


@query("s4_dimensions", f"""SELECT s.sensor_id, s.station_id, s.variable, CAST(s.calibration_date AS VARCHAR) AS calibration_date,
 {R('t.latitude')} AS latitude, {R('t.longitude')} AS longitude, t.elevation, t.region
 FROM sensors s JOIN stations t USING (station_id)""")
def s4(spark, sf):
    sensors, stations = fresh_path(spark, "sensors"), fresh_path(spark, "stations")
    fx.sensors(spark, sf).selectExpr("sensor_id as id", "station_id", "variable as sensor_type", "calibration_date").write.parquet(sensors)
    fx.stations(spark, sf).selectExpr("station_id as id", "latitude", "longitude", "elevation").write.parquet(stations)
    regions = fx.stations(spark, sf).select("station_id", "region")
    return io.read_sensors(spark, sensors).join(io.read_stations(spark, stations), "station_id").join(regions, "station_id").select(
        "sensor_id", "station_id", "variable", F.col("calibration_date").cast("string").alias("calibration_date"), r6("latitude"), r6("longitude"),
        "elevation", "region")


@query("s5_append_raw", "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM readings GROUP BY 1")
def s5(spark, sf):
    path = fresh_path(spark, "raw")
    r = fx.readings(spark, sf)
    io.append_raw(r.where("seq % 2 = 0"), path)
    io.append_raw(r.where("seq % 2 = 1"), path)
    return spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("n"))


@query("s6_write_table", f"""SELECT 'C-' || reading_id AS id, reading_id, {R('x')} AS original_value,
 {R('suggested_value')} AS suggested_value, 'SUGGESTED' AS status FROM suggested WHERE suggested_value IS NOT NULL""")
def s6(spark, sf):
    from gaugewise.operators import correction
    folder = fresh_path(spark, "tables")
    io.write_table(correction.corrections(evaluated(spark, sf)), "corrections", folder)
    return io.read_table(spark, "corrections", folder).select(
        "id", "reading_id", r6("original_value"), r6("suggested_value"), "status")


@query("s7_result_lookup", "SELECT reading_id, decision, trust_score FROM faults WHERE reading_id = 'R163'")
def s7(spark, sf):
    return io.result_for(evaluated(spark, sf), "R163").select("reading_id", "decision", "trust_score")


@query("s9_payload", f"""SELECT reading_id, station_id AS payload_station_id, ts AS payload_ts,
 {R('temperature')} AS temperature, {R('pressure')} AS pressure, {R('humidity')} AS humidity FROM readings""")
def s9(spark, sf):
    d = io.decode_payload(io.encode_payload(fx.readings(spark, sf)))
    return d.select("reading_id", "payload_station_id", naive("payload_ts"),
                    *[r6(f"payload_{v}", v) for v in VARIABLES])


@query("v1_required_fields", """SELECT reading_id, concat_ws(',', CASE WHEN station_id IS NULL THEN 'station_id' END,
 CASE WHEN temperature IS NULL THEN 'temperature' END) AS missing_fields,
 station_id IS NOT NULL AND temperature IS NOT NULL AS complete FROM dirty""")
def v1(spark, sf):
    return q.check_required(dirty(spark, sf)).select(
        "reading_id", F.concat_ws(",", "missing_fields").alias("missing_fields"), "complete")


@query("v2_normalise_ts", """SELECT reading_id, CASE seq % 4 WHEN 3 THEN NULL WHEN 2 THEN date_trunc('second', ts)
 - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS ts FROM readings""")
def v2(spark, sf):
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("seq") % 4
    text = (F.when(kind == 0, base).when(kind == 1, F.concat(base, F.lit("Z")))
            .when(kind == 2, F.concat(base, F.lit("+02:00"))).otherwise(F.concat(F.lit("at "), base)))
    return q.normalise_ts(fx.readings(spark, sf).withColumn("timestamp", text)).select("reading_id", naive("ts"))


@query("v3_humidity_range", "SELECT reading_id, humidity BETWEEN 0 AND 100 AS humidity_ok FROM dirty")
def v3(spark, sf):
    return q.check_humidity(dirty(spark, sf)).select("reading_id", "humidity_ok")


@query("v4_score_range", """SELECT reading_id, (k - 2) / 95.0 BETWEEN 0 AND 1 AND k + 3 BETWEEN 0 AND 100 AS scores_ok
 FROM readings""")
def v4(spark, sf):
    d = fx.readings(spark, sf).withColumn("anomaly_score", (F.col("k") - 2) / 95.0).withColumn(
        "trust_score", F.col("k") + 3)
    return q.check_scores(d, ["anomaly_score"], ["trust_score"]).select("reading_id", "scores_ok")


@query("v5_enum_domain", """SELECT reading_id, k % 4 <> 3 AS decision_ok, k % 10 <> 9 AS fault_ok FROM readings""")
def v5(spark, sf):
    from gaugewise.config import DECISIONS, FAULT_TYPES
    at = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("k") % n + 1).cast("int"))
    d = fx.readings(spark, sf).withColumn("decision", at([*DECISIONS, "maybe"], 4)).withColumn(
        "fault_type", at([*FAULT_TYPES, None, "drift"], 10))
    return q.check_enums(d).select("reading_id", "decision_ok", "fault_ok")


@query("v6_quarantine", "SELECT reading_id, seq % 13 = 0 OR seq % 17 = 0 AS quarantined FROM readings")
def v6(spark, sf):
    r = io.encode_payload(fx.readings(spark, sf))
    broken = (F.when(F.col("seq") % 13 == 0, F.expr("substr(raw_payload, 1, length(raw_payload) - 9)"))
              .when(F.col("seq") % 17 == 0, F.regexp_replace("raw_payload", '"pressure":[0-9.]+', '"pressure":"high"'))
              .otherwise(F.col("raw_payload")))
    good, bad = q.split_malformed(r.withColumn("raw_payload", broken))
    return good.select("reading_id", F.lit(False).alias("quarantined")).unionByName(
        bad.select("reading_id", F.lit(True).alias("quarantined")))


@query("v7_quality_flag", """SELECT reading_id, CASE WHEN temperature IS NULL THEN 'missing:temperature'
 WHEN temperature NOT BETWEEN -90 AND 60 THEN 'bounds:temperature' WHEN humidity NOT BETWEEN 0 AND 100
 THEN 'bounds:humidity' ELSE 'ok' END AS quality_flag FROM dirty""")
def v7(spark, sf):
    return q.flag_validity(dirty(spark, sf)).select("reading_id", "quality_flag")


@query("v8_orphan_readings", """SELECT reading_id, station_id FROM dirty d WHERE NOT EXISTS
 (SELECT 1 FROM stations s WHERE s.station_id = d.station_id)""")
def v8(spark, sf):
    return q.orphan_readings(dirty(spark, sf), fx.stations(spark, sf)).select("reading_id", "station_id")


@query("v9_enrich", f"""SELECT d.reading_id, d.station_id, {R('s.latitude')} AS latitude, {R('s.longitude')} AS longitude,
 s.elevation, s.region FROM dirty d LEFT JOIN stations s ON s.station_id = d.station_id""")
def v9(spark, sf):
    return q.enrich(dirty(spark, sf), fx.stations(spark, sf)).select(
        "reading_id", "station_id", r6("latitude"), r6("longitude"), "elevation", "region")


@query("v10_missingness", f"""SELECT station_id, variable, count(*) AS n, count(*) - count(x) AS n_missing,
 {R('(count(*) - count(x)) / CAST(count(*) AS DOUBLE)')} AS missing_rate FROM obs GROUP BY station_id, variable""")
def v10(spark, sf):
    return q.missingness(fx.readings(spark, sf)).select(
        "station_id", "variable", "n", "n_missing", r6("missing_rate"))


@query("v11_duplicates", "SELECT station_id, ts, count(*) AS copies FROM dirty GROUP BY 1, 2 HAVING count(*) > 1")
def v11(spark, sf):
    return q.duplicates(dirty(spark, sf)).select("station_id", naive("ts"), "copies")


@query("v12_dedupe", """SELECT reading_id, station_id, ts, seq FROM (SELECT *, row_number() OVER
 (PARTITION BY station_id, ts ORDER BY reading_id) AS rn FROM dirty) WHERE rn = 1 OR station_id IS NULL""")
def v12(spark, sf):
    return q.dedupe(dirty(spark, sf)).select("reading_id", "station_id", naive("ts"), "seq")


@query("v13_timestamp_audit", f"""SELECT station_id, count(*) AS n, count(*) - count(DISTINCT ts) AS n_repeated,
 count(*) FILTER (WHERE late) AS n_out_of_order, {R('any_value(cadence_s)')} AS cadence_s,
 count(*) FILTER (WHERE gap_s > 4 * cadence_s) AS n_gaps FROM (SELECT *, quantile_cont(gap_s, 0.5) OVER
  (PARTITION BY station_id) AS cadence_s FROM (SELECT *, t < max(t) OVER (PARTITION BY station_id
   ORDER BY arrival, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late,
   floor((t - lag(t) OVER (PARTITION BY station_id ORDER BY t, reading_id)) / 1e6) AS gap_s
  FROM (SELECT *, CASE WHEN seq % 11 = 0 THEN seq + 500 ELSE seq END AS arrival FROM dirty))) GROUP BY station_id""")
def v13(spark, sf):
    d = dirty(spark, sf).withColumn("arrival", F.when(F.col("seq") % 11 == 0, F.col("seq") + 500)
                                    .otherwise(F.col("seq")))
    return q.timestamp_audit(d, ingest="arrival").select(
        "station_id", "n", "n_repeated", "n_out_of_order", r6("cadence_s"), "n_gaps")


@query("v14_profile", f"""SELECT variable, count(*) AS n, count(*) - count(x) AS n_null,
 count(DISTINCT x) AS n_distinct, {R('min(x)')} AS min_x, {R('max(x)')} AS max_x,
 {R('quantile_cont(x, 0.05)')} AS p05, {R('quantile_cont(x, 0.5)')} AS p50,
 {R('quantile_cont(x, 0.95)')} AS p95 FROM obs GROUP BY variable""")
def v14(spark, sf):
    return q.profile(fx.readings(spark, sf)).select(
        "variable", "n", "n_null", "n_distinct", *map(r6, ("min_x", "max_x", "p05", "p50", "p95")))


@query("v15_select_stations", f"""SELECT station_id, days, n, {R('completeness')} AS completeness FROM (
 SELECT station_id, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n, count(*) FILTER (WHERE temperature IS NOT NULL
  AND pressure IS NOT NULL AND humidity IS NOT NULL) / CAST(count(*) AS DOUBLE) AS completeness
 FROM readings GROUP BY station_id) ORDER BY days DESC, completeness DESC, station_id LIMIT 10""")
def v15(spark, sf):
    return q.select_stations(fx.readings(spark, sf), 10).select("station_id", "days", "n", r6("completeness"))


@query("v16_raw_diff", """SELECT reading_id, CASE WHEN seq % 101 = 0 THEN 'lost' ELSE 'changed' END AS change
 FROM readings WHERE seq % 101 = 0 OR seq % 97 = 0""")
def v16(spark, sf):
    before = fx.readings(spark, sf)
    after = before.where("seq % 101 <> 0").withColumn("pressure", F.when(
        F.col("seq") % 97 == 0, F.col("pressure") + 1).otherwise(F.col("pressure")))
    return q.raw_diff(before, after)


@query("v16_rows_gone", """SELECT reading_id, station_id FROM readings WHERE seq % 101 = 0 OR seq % 97 = 0""")
def v16b(spark, sf):
    before = fx.readings(spark, sf).select("reading_id", "station_id", "pressure", "seq")
    after = before.where("seq % 101 <> 0").withColumn("pressure", F.when(
        F.col("seq") % 97 == 0, F.col("pressure") + 1).otherwise(F.col("pressure")))
    return q.rows_gone(before, after).select("reading_id", "station_id")


@query("v17_to_long", f"SELECT reading_id, station_id, ts, variable, {R('x')} AS x FROM obs")
def v17(spark, sf):
    return q.to_long(fx.readings(spark, sf)).select("reading_id", "station_id", naive("ts"), "variable", r6("x"))
