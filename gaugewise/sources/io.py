"""Batch and streaming sources, append-only sinks, lookups and JSON payload coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gaugewise import schemas
from gaugewise.functions.columns import micros
from gaugewise.operators.quality import normalise_ts

READING_FIELDS = ("station_id", "timestamp", "temperature", "pressure", "humidity")


def read_readings(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.READINGS
                  ) -> DataFrame:
    """Batch scan with the declared schema (Parquet, JSON, CSV or ORC), with the time ``t`` that operators order by."""
    rows = spark.read.format(fmt).schema(schema).load(path)
    return rows.withColumn("t", micros(F.col("ts"))) if "ts" in rows.columns else rows


def read_payloads(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Contract rows as operators take them: UTC time, ``t``, a content key, no wind. Rows whose time cannot be read
    keep their other fields and a NULL time, for the quarantine to name."""
    rows = normalise_ts(read_readings(spark, path, fmt, schemas.WEATHER_READING))
    return with_reading_id(rows).withColumn("t", micros(F.col("ts"))).withColumn(
        "wind_speed", F.lit(None).cast("double"))


def with_reading_id(df: DataFrame) -> DataFrame:
    """Content key for payloads that come without one."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
        "station_id", "ts", "temperature", "pressure", "humidity")])
    return df.withColumn("reading_id", F.sha2(text, 256))


def stream_readings(spark: SparkSession, path: str, fmt: str = "json",
                    schema: str = schemas.WEATHER_READING, **options: str) -> DataFrame:
    """Streaming ingest from a folder of files."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def replay(spark: SparkSession, path: str, files_per_trigger: int, fmt: str = "parquet",
           schema: str = schemas.READINGS, **options: str) -> DataFrame:
    """Historical replay: the stream source, throttled to a number of files per micro-batch."""
    return stream_readings(spark, path, fmt, schema, maxFilesPerTrigger=str(files_per_trigger), **options)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """The station table; its key is named as in readings."""
    return spark.read.schema(schemas.STATIONS).parquet(path).withColumnRenamed("id", "station_id")


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """The sensor table, named as the roll-ups name sensors."""
    return spark.read.schema(schemas.SENSORS).parquet(path).withColumnsRenamed(
        {"id": "sensor_id", "sensor_type": "variable"})


def append_raw(df: DataFrame, path: str) -> None:
    """Append raw readings, partitioned by day; the API has no way to overwrite them. Rows are rebalanced by day: small
    days share a task and a large one is split, so the number of files follows the bytes."""
    (df.withColumn("dt", F.to_date("ts")).hint("rebalance", "dt")
     .write.mode("append").partitionBy("dt").parquet(path))


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Project to a table's declared schema; columns that the roll-up does not have are NULL."""
    schema = df.sparkSession.createDataFrame([], schemas.TABLES[name]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def write_table(df: DataFrame, name: str, folder: str, run: str = "0") -> None:
    """Write one run's rows of a derived table. A repeated run replaces its own rows, so a retried job doubles none."""
    as_table(df, name).write.mode("overwrite").parquet(f"{folder}/{name}/run={run}")


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """All runs of a derived table."""
    return spark.read.schema(schemas.TABLES[name] + ", run string").parquet(f"{folder}/{name}").drop("run")


def result_for(df: DataFrame, reading_id: str) -> DataFrame:
    """One stored evaluation; the filter reaches the Parquet scan."""
    return df.where(F.col("reading_id") == reading_id)


def stream_results(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Feed of results as an append-only Parquet sink."""
    return (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path))


def payload_json(ts: str = "ts") -> Column:
    """The ingestion contract as JSON text; NULL members are kept out of the text, parts of a second are not."""
    whole = F.date_trunc("second", ts) == F.col(ts)
    stamp = F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return F.to_json(F.struct(
        F.col("station_id"), stamp.alias("timestamp"),
        F.col("temperature"), F.col("pressure"), F.col("humidity")))


def encode_payload(df: DataFrame) -> DataFrame:
    return df.withColumn("raw_payload", payload_json())


def decode_payload(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    d = F.from_json(payload, schemas.WEATHER_READING)
    out = df.withColumn("_d", d).select("*", *[F.col(f"_d.{c}").alias(f"payload_{c}") for c in READING_FIELDS])
    return out.withColumn("payload_ts", F.try_to_timestamp("payload_timestamp")).withColumn(
        "payload_t", micros(F.col("payload_ts"))).drop("_d")
