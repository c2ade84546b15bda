"""Weather tables derived from the driver's generic tables (exact arithmetic, no randomness)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewise.config import CORRECTION_STATUSES, VARIABLES
from gaugewise.functions.columns import micros
from gaugewise.session import spread, tune

EVENTS_DDL = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def readings_from(events: DataFrame) -> DataFrame:
    """Map event rows (batch or stream) onto the reading schema."""
    k = F.get_json_object("props", "$.k").cast("int")
    off_noon = F.abs(F.hour("ts") - 14).cast("double")
    error = F.col("event_type") == "error"
    dropout, spike = error & (k >= 95), error & (k < 10)
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.concat(F.lit("R"), F.col("event_id").cast("string")).alias("reading_id"),
        F.concat(F.lit("AWS-"), F.col("user_id").cast("string")).alias("station_id"),
        ts.alias("ts"), micros(ts).alias("t"),
        F.when(~dropout, 20 - 0.5 * off_noon + F.col("value") / 32
               + F.when(spike, 30.0).otherwise(0.0)).alias("temperature"),
        (1000 + F.day("ts") % 10 + (F.col("event_id") % 7) / 8).cast("double").alias("pressure"),
        (60 + 2 * off_noon + (k - 50) / 8).cast("double").alias("humidity"),
        F.lit(None).cast("double").alias("wind_speed"),
        F.when(dropout, "dropout").when(spike, "temperature_spike").alias("truth"),
        F.col("event_id").alias("seq"), k.alias("k"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from(spread(load(spark, sf_dir, "events"), "event_id"))


def broken_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings with NaN, infinities and sentinels in a tenth of the rows, runs of two among them."""
    kind, nan = F.col("seq") % 50, F.lit(float("nan"))
    return readings(spark, sf_dir).withColumns({
        "temperature": F.when(kind == 7, nan).when(kind.isin(19, 20), -9999.0).otherwise(F.col("temperature")),
        "pressure": F.when(kind == 31, float("inf")).when(kind == 33, -9999.0).otherwise(F.col("pressure")),
        "humidity": F.when(kind == 19, 150.0).when(kind == 41, nan).otherwise(F.col("humidity"))})


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return load(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("AWS-"), u.cast("string")).alias("station_id"),
        (20 + (u % 50) * 0.1).alias("latitude"),
        (70 + F.floor(u / 50) * 0.1).alias("longitude"),
        (u * 37 % 900).cast("double").alias("elevation"),
        (u % 5).cast("int").alias("region"),
        u.alias("station_no"))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(i).alias("i"))
                               for i, v in enumerate(VARIABLES)]))
    return stations(spark, sf_dir).withColumn("_v", each).select(
        F.concat_ws(":", "station_id", "_v.variable").alias("sensor_id"),
        "station_id", F.col("_v.variable").alias("variable"),
        F.date_add(F.lit("2023-01-01").cast("date"),
                   ((F.col("station_no") * 13 + F.col("_v.i") * 7) % 365).cast("int"))
        .alias("calibration_date"))


def correction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in CORRECTION_STATUSES]),
                          (F.col("o_orderkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit("R"), F.col("o_custkey").cast("string")).alias("reading_id"),
        F.col("o_orderkey").alias("event_no"),
        F.col("o_orderdate").cast("timestamp").alias("event_ts"), status.alias("status"),
        F.concat(F.lit("reviewer-"), (F.col("o_orderkey") % 7).cast("string")).alias("actor"))
