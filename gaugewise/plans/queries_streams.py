"""Registered queries: streams driven to completion over the given event file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewise.operators import impact as im, quality as q
from gaugewise.plans.oracle import DAY1, R
from gaugewise.plans.registry import naive, query, r6
from gaugewise.session import fresh_path
from gaugewise.sources import fixtures as fx, io
from gaugewise.streaming import ingest, online, state


FILES = 8


def stream(spark: SparkSession, sf: str) -> DataFrame:
    events = io.stream_readings(spark, sf, "parquet", fx.EVENTS_DDL, pathGlobFilter="events.parquet")
    return fx.readings_from(events)


def as_files(spark: SparkSession, sf: str, *parts: str) -> str:
    """The events as ``FILES`` files per predicate, so that a replay of as many files per micro-batch runs one
    micro-batch for each; a file is a task's share, whatever the table's size."""
    path = fresh_path(spark, "replay")
    events = fx.load(spark, sf, "events")
    for rows in parts:
        events.where(rows).repartition(FILES).write.mode("append").parquet(path)
    return path


@query("s2_stream_readings", f"SELECT reading_id, station_id, ts, {R('temperature')} AS temperature FROM readings")
def s2(spark, sf):
    out, _ = ingest.run_to_table(stream(spark, sf).drop("truth", "seq", "k"), "s2")
    return out.select("reading_id", "station_id", naive("ts"), r6("temperature"))


@query("s3_replay", "SELECT reading_id, station_id, ts FROM readings")
def s3(spark, sf):
    events = io.replay(spark, as_files(spark, sf, "event_id % 2 = 0", "event_id % 2 = 1"), FILES, schema=fx.EVENTS_DDL)
    out, _ = ingest.run_to_table(fx.readings_from(events).select("reading_id", "station_id", "ts"), "s3")
    return out.select("reading_id", "station_id", naive("ts"))


@query("s8_result_feed", "SELECT reading_id, 'missing:temperature' AS quality_flag FROM readings WHERE temperature IS NULL")
def s8(spark, sf):
    flagged = q.flag_validity(stream(spark, sf)).where("quality_flag <> 'ok'").select("reading_id", "quality_flag")
    return ingest.run_to_table(flagged, "s8")[0]


@query("l1_stream_dedupe", "SELECT reading_id, station_id, ts FROM readings")
def l1(spark, sf):
    rows = stream(spark, sf).select("reading_id", "station_id", "ts", "pressure", "humidity", "seq")
    doubled = rows.withColumn("_i", F.explode(F.when(F.col("seq") % 5 == 0, F.array(F.lit(0), F.lit(1)))
                                              .otherwise(F.array(F.lit(0))))).drop("_i")
    out, _ = ingest.run_validated(doubled, "l1")
    return out.select("reading_id", "station_id", naive("ts"))


@query("l2_stream_tumbling", f"""SELECT station_id, start_ts, n, mean_temperature FROM (SELECT station_id,
 date_trunc('day', ts) AS start_ts, count(*) AS n, {R('avg(temperature)')} AS mean_temperature FROM readings GROUP BY 1, 2)
 WHERE start_ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM readings) - INTERVAL 1 HOUR""")
def l2(spark, sf):
    out, _ = ingest.run_to_table(ingest.station_windows(stream(spark, sf), "1 day"), "l2")
    return out.select("station_id", naive("start_ts"), "n", r6("mean_temperature"))


@query("l2_stream_sliding", """SELECT station_id, start_ts, count(*) AS n FROM (SELECT station_id,
  date_trunc('day', ts) - o * INTERVAL 12 HOUR + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS start_ts
  FROM readings, (VALUES (0), (1)) AS v(o))
 WHERE start_ts + INTERVAL 24 HOUR <= (SELECT max(ts) FROM readings) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def l2b(spark, sf):
    out, _ = ingest.run_to_table(ingest.station_windows(stream(spark, sf), "24 hours", "12 hours"), "l2s")
    return out.select("station_id", naive("start_ts"), "n")


@query("l3_fault_episodes", """SELECT station_id, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS n_flagged FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER
   (PARTITION BY station_id ORDER BY ts) AS episode
  FROM (SELECT station_id, ts, lag(ts) OVER (PARTITION BY station_id ORDER BY ts) AS prev FROM readings
   WHERE temperature IS NULL OR temperature > 40)) GROUP BY station_id, episode
 HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM readings WHERE temperature IS NULL OR temperature > 40)
  - INTERVAL 1 HOUR""")
def l3(spark, sf):
    flagged = stream(spark, sf).where("temperature is null or temperature > 40").select("station_id", "ts")
    out, _ = ingest.run_to_table(ingest.fault_episodes(flagged), "l3")
    return out.select("station_id", naive("start_ts"), naive("last_ts"), "n_flagged")


LATE_PARTS = ("day(ts) <= 10 and event_id % 10 <> 3", "day(ts) between 11 and 20 and event_id % 10 <> 4",
              "day(ts) <= 10 and event_id % 10 = 3", "day(ts) > 20 or day(ts) between 11 and 20 and event_id % 10 = 4")


@query("l4_track_sensors", f"""SELECT reading_id, variable, late, CASE WHEN NOT late THEN run_length END AS run_length,
  {R('CASE WHEN NOT late THEN (x - lx) / nullif((t - lt) / 6e7, 0) END')} AS rate,
  {R('CASE WHEN NOT late AND n >= 8 AND sd > 1e-5 THEN (x - mean) / sd END')} AS z FROM (
 SELECT *, row_number() OVER (PARTITION BY station_id, variable, late, run ORDER BY t, reading_id) AS run_length FROM (
  SELECT *, sum(CASE WHEN lx IS NULL OR lx <> x THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, variable, late
    ORDER BY t, reading_id) AS run
  FROM (SELECT *, lag(x) OVER w AS lx, lag(t) OVER w AS lt, count(x) OVER p AS n, avg(x) OVER p AS mean, stddev_samp(x) OVER p AS sd
   FROM (SELECT *, coalesce(t <= passed - {DAY1}, false) AS late, max(newest) OVER (PARTITION BY station_id, variable) AS final
    FROM (SELECT o.*, max(t) OVER (PARTITION BY station_id, variable, b) AS newest,
      max(t) OVER (PARTITION BY station_id, variable ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed
     FROM (SELECT o.*, CASE WHEN day(ts) <= 10 THEN CASE WHEN seq % 10 = 3 THEN 2 ELSE 0 END WHEN day(ts) > 20 OR seq % 10 = 4
        THEN 3 ELSE 1 END AS b FROM obs o JOIN (SELECT reading_id, seq FROM readings) USING (reading_id) WHERE x IS NOT NULL) o))
   WINDOW w AS (PARTITION BY station_id, variable, late ORDER BY t, reading_id),
   p AS (PARTITION BY station_id, variable, late ORDER BY t, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))
 WHERE late OR t <= final - {DAY1}""")
def l4(spark, sf):
    """Four micro-batches; some readings come one or two batches after their days, most of them too late."""
    events = io.replay(spark, as_files(spark, sf, *LATE_PARTS), FILES, schema=fx.EVENTS_DDL)
    tracked = state.track_sensors(q.to_long(fx.readings_from(events)), delay_us=DAY1)
    out, _ = ingest.run_to_table(tracked, "l4")
    return out.select("reading_id", "variable", "late", "run_length", r6("rate"), r6("z"))


@query("l5_online_scoring", f"""SELECT reading_id, decision, fault_type, trust_score, {R('confidence')} AS confidence
 FROM faults WHERE anomaly""")
def l5(spark, sf):
    """Four throttled micro-batches, a tenth of the first days' readings among the last: the same as the batch plan."""
    late = "(event_id % 10 = 3 and day(ts) <= 12)"
    path = as_files(spark, sf, f"day(ts) <= 12 and not {late}", "day(ts) between 13 and 18", "day(ts) between 19 and 24",
                    f"day(ts) > 24 or {late}")
    events = io.replay(spark, path, FILES, schema=fx.EVENTS_DDL)
    folder = fresh_path(spark, "online")
    online.score_stream(fx.readings_from(events), fx.stations(spark, sf), folder,
                        fresh_path(spark, "online-checkpoint")).awaitTermination()
    return online.read_scored(spark, folder, "final_evaluations").select(
        "reading_id", "decision", "fault_type", "trust_score", r6("confidence"))


@query("l6_late_rows", """SELECT station_id, start_ts, n, n_streamed FROM (SELECT station_id, date_trunc('day', ts) AS start_ts,
  count(*) AS n, count(*) FILTER (WHERE seq % 10 <> 0) AS n_streamed FROM readings GROUP BY 1, 2)
 WHERE n <> n_streamed AND n_streamed > 0 AND start_ts + INTERVAL 1 DAY <=
  (SELECT max(ts) FROM readings WHERE seq % 10 > 1) - INTERVAL 1 HOUR""")
def l6(spark, sf):
    """The last of three micro-batches arrives behind the watermark; the batch re-run finds its windows."""
    path = as_files(spark, sf, "event_id % 10 > 1", "event_id % 10 = 1", "event_id % 10 = 0")
    events = io.replay(spark, path, FILES, schema=fx.EVENTS_DDL)
    streamed, _ = ingest.run_to_table(ingest.station_windows(fx.readings_from(events), "1 day"), "l6")
    return ingest.revisions(im.downsample(fx.readings(spark, sf)), streamed).select(
        "station_id", naive("start_ts"), "n", "n_streamed")


@query("l6_late_counts", """SELECT CAST(b AS BIGINT) AS batch, start_ts, count(*) AS n_late FROM (
  SELECT *, date_trunc('day', ts) AS start_ts, max(newest) OVER (ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed
  FROM (SELECT *, max(ts) OVER (PARTITION BY b) AS newest FROM (SELECT *, CASE WHEN seq % 10 = 3 AND day(ts) <= 12 THEN 2
    WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 3 END AS b FROM readings)))
 WHERE start_ts + INTERVAL 1 DAY <= passed - INTERVAL 1 HOUR GROUP BY b, start_ts""")
def l6_counts(spark, sf):
    """Four micro-batches, the third of them rows of days that the second has closed, or not quite."""
    late = "(event_id % 10 = 3 and day(ts) <= 12)"
    path = as_files(spark, sf, f"day(ts) <= 10 and not {late}", f"day(ts) between 11 and 20 and not {late}", late, "day(ts) > 20")
    events = io.replay(spark, path, FILES, schema=fx.EVENTS_DDL)
    landed, _ = ingest.land(fx.readings_from(events), "l6-landed")
    return ingest.late_counts(landed, "1 day").select("batch", naive("start_ts"), "n_late")


@query("l7_silent_stations", """SELECT station_id, last_t, n FROM (SELECT station_id, max(t) AS last_t, count(*) AS n,
  CAST(trunc(4e0 * (max(t) - min(t)) / (count(*) - 1)) AS BIGINT) AS limit_us FROM readings GROUP BY station_id HAVING count(*) > 1)
 WHERE (last_t + limit_us) // 1000 + 1 <= (SELECT max(t) FROM readings) // 1000 - 3600000""")
def l7(spark, sf):
    out, _ = ingest.run_to_table(state.silent_stations(stream(spark, sf)), "l7")
    return out.select("station_id", "last_t", "n")
