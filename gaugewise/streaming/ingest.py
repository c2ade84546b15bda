"""Streaming forms of validation, deduplication, windows, sessions and late-row revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from gaugewise.config import VARIABLES
from gaugewise.operators.quality import check_required
from gaugewise.session import fresh_path
from gaugewise.sources.io import stream_results


#: Without these a reading cannot be placed or told from its repeats; a missing temperature is evidence and passes.
NEEDED = ("reading_id", "station_id", "ts", "pressure", "humidity")


def validated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Complete readings, each reading_id once: repeats within the watermark delay are dropped."""
    ok = check_required(stream, NEEDED).where("complete")
    return ok.drop("missing_fields", "complete").withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["reading_id"])


def quarantined(stream: DataFrame) -> DataFrame:
    """The readings that ``validated`` leaves out as incomplete, all of them, with ``missing_fields``."""
    return check_required(stream, NEEDED).where("not complete").drop("complete")


def station_windows(stream: DataFrame, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Tumbling or sliding means per station; a window is emitted once, when the watermark closes it."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", delay).groupBy("station_id", w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in VARIABLES]).select(
        "station_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n",
        *[f"mean_{v}" for v in VARIABLES])


def fault_episodes(flagged: DataFrame, gap: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions of flagged readings per station: an episode ends after ``gap`` without a flag."""
    return flagged.withWatermark("ts", delay).groupBy("station_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_flagged"), F.max("ts").alias("last_ts")).select(
        "station_id", F.col("w.start").alias("start_ts"), "last_ts", "n_flagged")


def run_to_table(stream: DataFrame, name: str) -> tuple[DataFrame, StreamingQuery]:
    """Drive a stream over everything available into a Parquet table; returns the table and the query."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    q = stream_results(stream, out, fresh_path(spark, f"{name}-checkpoint"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), q


def run_validated(stream: DataFrame, name: str, delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Drive a stream into a table of complete readings without repeats and, next to it, one of incomplete readings."""
    good, _ = run_to_table(validated(stream, delay), name)
    return good, run_to_table(quarantined(stream), f"{name}-quarantine")[0]


def land(stream: DataFrame, name: str) -> tuple[DataFrame, StreamingQuery]:
    """Drive a stream into a table that keeps the number of the micro-batch that brought each row, as ``batch``; a
    retried micro-batch replaces its rows."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, name)
    q = (stream.writeStream.foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{path}/batch={i}"))
         .option("checkpointLocation", fresh_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path), q


def late_rows(landed: DataFrame, width: str, delay: str = "1 hour") -> DataFrame:
    """The rows of a landed table that came when the window of ``width`` they belong to was closed already: the newest
    time of the micro-batches before theirs, less ``delay``, had passed its end. With the window's ``start_ts``."""
    newest = landed.groupBy("batch").agg(F.max("ts").alias("newest"))  # one row per micro-batch
    earlier = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    closed = newest.select("batch", (F.max("newest").over(earlier) - F.expr(f"interval {delay}")).alias("closed"))
    rows = landed.withColumn("_w", F.window("ts", width)).join(closed, "batch")
    return rows.where("_w.end <= closed").withColumn("start_ts", F.col("_w.start")).drop("_w", "closed")


def late_counts(landed: DataFrame, width: str, delay: str = "1 hour") -> DataFrame:
    """How many late rows each micro-batch brought for each window."""
    return late_rows(landed, width, delay).groupBy("batch", "start_ts").agg(F.count(F.lit(1)).alias("n_late"))


def revisions(batch: DataFrame, streamed: DataFrame) -> DataFrame:
    """Windows the batch re-run must replace, because late rows changed their content."""
    s = streamed.select("station_id", "start_ts", F.col("n").alias("n_streamed"))
    both = batch.select("station_id", "start_ts", "n").join(s, ["station_id", "start_ts"])
    return both.where(F.col("n") != F.col("n_streamed"))
