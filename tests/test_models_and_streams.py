"""Learned scores rank planted faults first; online scoring survives a retried batch."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gaugewise.config import DEFAULT
from gaugewise.operators import correction, health, inject, models, quality, signals
from gaugewise.operators.stations import neighbours
from gaugewise.sources import fixtures as fx, io
from gaugewise.streaming import ingest, online, state

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("signal", ["isolation_forest", "autoencoder"])
def test_scores_are_bounded_and_rank_faults(spark, signal):
    clean = models.model_features(fx.readings(spark, SF)).drop("truth")
    data = inject.inject(clean, "temperature_spike", 50, 1, F.col("seq")).withColumnRenamed("fault_type", "truth")
    if signal == "isolation_forest":
        out = models.isolation_forest_score(models.isolation_forest_fit(data), data)
    else:
        out = models.reconstruction_score(models.reconstruction_fit(data), data)
    out = out.cache()
    assert out.where(~F.col(signal).between(0, 1)).count() == 0
    assert out.where(F.col("temperature").isNull() & F.col(signal).isNotNull()).count() == 0
    assert signals.roc_auc(out, signal).first().auc > 0.75


def test_isolation_forest_is_deterministic(spark):
    data = models.model_features(fx.readings(spark, SF))
    a, b = (models.isolation_forest_fit(data, trees=5, psi=32).nodes for _ in range(2))
    key = ["tree", "node"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))


def test_retried_batch_leaves_no_duplicates(spark, tmp_path):
    rows, stations = fx.readings(spark, SF), fx.stations(spark, SF)
    folder = str(tmp_path / "online")
    first, second = rows.where("seq < 700"), rows.where("seq >= 700")
    online.score_batch(first, 0, stations, folder)
    online.score_batch(second, 1, stations, folder)
    before = online.read_scored(spark, folder, "anomalies")
    n, raw = before.count(), spark.read.parquet(f"{folder}/raw").count()
    online.score_batch(second, 1, stations, folder)
    again = online.read_scored(spark, folder, "anomalies")
    assert n == raw == again.count() == rows.count()
    assert again.select("reading_id").distinct().count() == n
    written = spark.read.parquet(f"{folder}/anomalies/batch=1").select("station_id").distinct()
    near = neighbours(stations, 30.0).join(second.select("station_id").distinct(), "station_id").selectExpr(
        "neighbour_id as station_id")
    touched = second.select("station_id").unionAll(near)
    assert written.join(touched, "station_id", "left_anti").count() == 0, "other stations are left alone"


def test_result_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "results")
    spark.range(100).select(F.concat(F.lit("R"), "id").alias("reading_id"), "id").write.parquet(path)
    found = io.result_for(spark.read.parquet(path), "R7")
    assert [r.id for r in found.collect()] == [7]
    assert "EqualTo(reading_id,R7)" in found._jdf.queryExecution().executedPlan().toString()


def test_incomplete_readings_are_quarantined(spark, tmp_path):
    path = str(tmp_path / "rows")
    ddl = "reading_id string, station_id string, ts timestamp, temperature double, pressure double, humidity double"
    spark.sql("""SELECT * FROM VALUES ('a', 's', timestamp'2024-01-01', 1d, 2d, 3d), ('a', 's', timestamp'2024-01-01', 1d,
      2d, 3d), ('b', 's', timestamp'2024-01-01', NULL, 2d, 3d), ('c', NULL, timestamp'2024-01-01', 1d, NULL, 3d),
      ('d', 's', NULL, 1d, 2d, 3d), ('d', 's', NULL, 1d, 2d, 3d), (NULL, 's', timestamp'2024-01-01', 1d, 2d, NULL)
      AS t(reading_id, station_id, ts, temperature, pressure, humidity)""").write.parquet(path)
    good, bad = ingest.run_validated(spark.readStream.schema(ddl).parquet(path), "validated")
    assert sorted(r["reading_id"] for r in good.collect()) == ["a", "b"]
    assert sorted((r["reading_id"] or "", tuple(r["missing_fields"])) for r in bad.collect()) == [
        ("", ("reading_id", "humidity")), ("c", ("station_id", "pressure")), ("d", ("ts",)), ("d", ("ts",))]


def brute_steps(events):
    """The lifecycle one event at a time."""
    out, at = {}, {}
    for reading, no, t, status in sorted(events, key=lambda e: (e[2], e[1])):
        step = {"SUGGESTED": 0, "PENDING_REVIEW": 1, "ACCEPTED": 2, "REJECTED": 2}.get(status)
        out[no] = reading is not None and step is not None and at.get(reading, 0) == step
        at[reading] = at.get(reading, 0) + out[no]
    return out


@pytest.mark.parametrize("days", [365, 7, 1])
def test_lifecycle_folds_over_chunks(spark, days):
    rng = random.Random(days)
    kinds = ["SUGGESTED", "PENDING_REVIEW", "ACCEPTED", "REJECTED", "OTHER", None]
    events = [(rng.choice(["hot", "hot", "a", "b", "c", "d", "e", "f", None]), i, 86_400_000_000 * rng.randrange(-5, 60)
               + rng.randrange(3), rng.choices(kinds, [2, 3, 3, 3, 1, 1])[0]) for i in range(400)]
    df = spark.createDataFrame(events, "reading_id string, event_no long, t long, status string").selectExpr(
        "reading_id", "event_no", "timestamp_micros(t) as event_ts", "status", "concat('r', event_no) as actor")
    cfg = replace(DEFAULT, lifecycle_us=days * 86_400_000_000)
    want, steps = brute_steps(events), correction.legal_steps(df, cfg)
    assert {r.event_no: r.legal for r in steps.collect()} == want
    for r in correction.correction_status(df, cfg).collect():
        own = sorted((e for e in events if e[0] == r.reading_id), key=lambda e: (e[2], e[1]))
        legal = [e for e in own if want[e[1]]]
        assert (r.n_events, r.n_illegal) == (len(own), len(own) - len(legal))
        assert (r.status, r.reviewed_by) == ((legal[-1][3], f"r{legal[-1][1]}") if legal else (None, None))
    text = steps._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.replace("ReusedExchange", "").count("Exchange hashpartitioning") <= 3, "the events are shuffled once"


def test_queue_spreads_sensors_of_one_priority(spark):
    rows = spark.range(4000).selectExpr("concat('s', lpad(id, 5, '0')) as sensor_id", "'a' as station_id", "'v' as variable",
                                        "if(id < 10, 1D, 0D) as priority", "50D as health_score", "'bias' as fault_reason")
    queue = health.maintenance_queue(rows)
    assert [r.priority_rank for r in queue.orderBy(F.desc("priority"), "sensor_id").collect()] == list(range(1, 4001))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = health.ranged(rows.withColumn("_neg", -F.col("priority")), ["_neg", "sensor_id"], "test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spread.groupBy("_range").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1500


def test_arrivals_of_any_scale_and_without_a_station(spark):
    rng = random.Random(3)
    start = 1_704_067_200_000_000
    rows = [(f"R{i:04d}", rng.choice(["hot", "hot", "s", None]), start + rng.randrange(500) * 60_000_000,
             start + i * 7_919_000_123) for i in range(600)]
    df = spark.createDataFrame(rows, "reading_id string, station_id string, t long, arrived long").withColumn(
        "ts", F.timestamp_micros("t"))
    got = {r.station_id: (r.n, r.n_out_of_order) for r in quality.timestamp_audit(df, ingest="arrived").collect()}
    for station in ("hot", "s", None):
        times = [r[2] for r in sorted(rows, key=lambda r: r[3]) if r[1] == station]
        late = sum(t < max(times[:i], default=t) for i, t in enumerate(times))
        assert got[station] == (len(times), late)


def test_tracking_does_not_depend_on_the_order_within_the_delay(spark, tmp_path):
    """Sorted and shuffled micro-batches give the same rows; what comes after its place is told apart and changes nothing."""
    rng, minute = random.Random(6), 60_000_000
    rows = [(f"r{i:03d}", "ab"[i % 2], "temperature", i * minute, float(rng.choice([1, 1, 2]))) for i in range(240)]
    jittered = sorted(rows, key=lambda r: r[3] + rng.randrange(40) * minute)
    ddl = "reading_id string, station_id string, variable string, t long, x double"
    found = []
    for name, order in (("sorted", rows), ("shuffled", jittered), ("late", [
            *jittered[:150], ("late", "a", "temperature", 5 * minute, 9.0), *jittered[150:]])):
        folder = str(tmp_path / name)
        for b in range(4):
            spark.createDataFrame(order[b * 60:b * 60 + 60 + (b == 3)], ddl).coalesce(1).write.mode("append").parquet(folder)
        stream = io.stream_readings(spark, folder, "parquet", ddl, maxFilesPerTrigger="1")
        out, q = ingest.run_to_table(state.track_sensors(stream, delay_us=100 * minute), f"track-{name}")
        assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 4
        found.append({r.reading_id: tuple(r) for r in out.collect()})
    assert found[0] == found[1] and len(found[0]) == 140
    assert not any(r[5] for r in found[0].values())
    late = found[2].pop("late")
    assert late[5] is True and late[6:] == (None, None, None) and found[2] == found[1]
