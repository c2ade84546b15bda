"""Worked scenarios on a hand-made network: storm front, broken probe, lone station, frozen and dead sensors."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gaugewise.operators import correction, faults
from gaugewise.plans import evaluate
from gaugewise.session import cut

MINUTE = 60_000_000
START = 1_704_067_200_000_000
STEPS = 8 * 96
CLOSE = ["S0", "S1", "S2", "S3", "S4"]


def calm(i: int, station: int) -> tuple[float, float, float]:
    day = math.sin(2 * math.pi * (i % 96) / 96)
    wiggle = ((i * 37 + station * 11) % 17 - 8) / 40
    return 22 + 3 * day + wiggle, 1008 + 0.5 * day + wiggle / 4, 55 - 6 * day - 2 * wiggle


def network() -> tuple[list[tuple], int]:
    rows = []
    for s, name in enumerate([*CLOSE, "LONE"]):
        for i in range(STEPS):
            te, pr, hu = calm(i, s)
            rows.append((f"{name}-{i:04d}", name, START + i * 15 * MINUTE, te, pr, hu))
    end = START + STEPS * 15 * MINUTE
    return rows, end


def judge(spark, extra: list[tuple]):
    rows, _ = network()
    replaced = {r[0] for r in extra}
    data = [r for r in rows if r[0] not in replaced] + extra
    df = spark.createDataFrame(data, "reading_id string, station_id string, t long, temperature double, "
                                     "pressure double, humidity double")
    df = df.withColumn("ts", F.timestamp_micros("t")).withColumn("wind_speed", F.lit(None).cast("double"))
    stations = spark.createDataFrame(
        [(n, 50.0 + i * 0.03, 8.0 + i * 0.02) for i, n in enumerate(CLOSE)] + [("LONE", 10.0, 179.9)],
        "station_id string, latitude double, longitude double")
    return evaluate.evaluated(cut(df, "scenario"), stations)


@pytest.fixture(scope="module")
def results(spark):
    _, end = network()
    last = {n: calm(STEPS - 1, s) for s, n in enumerate(CLOSE + ["LONE"])}
    extra = []
    # A storm front passes S0 and its neighbours; one probe of a lone station jumps alone.
    for n in CLOSE[:5]:
        te, pr, _ = last[n]
        extra.append((f"storm-{n}", n, end, te - 12, pr - 8, 95.0))
    te, pr, hu = last["LONE"]
    extra.append(("lone", "LONE", end - 10 * MINUTE, te + 25, pr, hu))
    found = {r.reading_id: r for r in judge(spark, extra).where("anomaly").collect()}
    # A separate run without the storm: S2's probe breaks within one minute.
    te, pr, hu = last["S2"]
    broken = {r.reading_id: r for r in judge(
        spark, [("broken", "S2", end - 14 * MINUTE, 58.0, pr, hu), ("after", "S2", end, te, pr, hu)]
    ).where("anomaly").collect()}
    return found, broken


def test_storm_is_genuine_and_trusted(results):
    storm = results[0]["storm-S0"]
    assert storm.decision == "genuine_weather" and storm.trust_score >= 80
    assert storm.fault_type is None and storm.suggested_value is None
    assert storm.n_agree == 4


def test_broken_probe_is_a_fault_and_not_trusted(results):
    row = results[1]["broken"]
    assert row.decision == "sensor_fault" and row.trust_score <= 25
    assert row.fault_type == "temperature_spike"
    assert abs(row.suggested_value - 20) < 5
    assert any("Nearby stations disagree" in s for s in row.explanation)


def test_equal_anomaly_scores_opposite_trust(results):
    a, b = results[0]["storm-S0"], results[1]["broken"]
    assert a.anomaly_score == pytest.approx(b.anomaly_score, abs=0.05)
    assert a.trust_score - b.trust_score > 50


def test_lone_station_stays_uncertain(results):
    row = results[0]["lone"]
    assert row.decision == "uncertain" and row.n_neighbours == 0 and row.cross_station is None


def test_missing_values(spark):
    _, end = network()
    _, pr, hu = calm(0, 0)
    rows = judge(spark, [("single", "S1", end, None, pr, hu), ("run-a", "S3", end, None, pr, hu),
                         ("run-b", "S3", end + 15 * MINUTE, None, pr, hu)]).where("anomaly").collect()
    by = {r.reading_id: r for r in rows}
    assert by["single"].decision == "uncertain"
    assert by["run-a"].decision == by["run-b"].decision == "sensor_fault"
    assert by["run-a"].fault_type == "dropout" and by["run-a"].trust_score == 0
    assert by["run-a"].suggested_value is not None


def test_constant_series_is_frozen_and_divides_by_nothing(spark):
    rows = [(f"R{i:03d}", "S", START + i * 6 * 60 * MINUTE, 7.5, 1000.0 + i, 50.0 + i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "reading_id string, station_id string, t long, temperature double, "
                                     "pressure double, humidity double")
    out = faults.frozen_flags(df).collect()
    assert {(r.variable, r.run_length, r.is_frozen) for r in out} == {
        ("temperature", 40, True), ("pressure", 1, False), ("humidity", 1, False)}


def test_correction_flow(spark):
    raw = spark.createDataFrame([("R1", 55.0, 1000.0, 50.0), ("R2", 54.0, 1000.0, 50.0)],
                                "reading_id string, temperature double, pressure double, humidity double")
    fix = spark.createDataFrame([("R1", "temperature", 31.8), ("R2", "temperature", 31.8)],
                                "reading_id string, suggested_variable string, suggested_value double")
    steps = [("R1", "SUGGESTED", 1), ("R1", "PENDING_REVIEW", 2), ("R1", "ACCEPTED", 3), ("R2", "SUGGESTED", 1),
             ("R2", "ACCEPTED", 2), ("R2", "PENDING_REVIEW", 3), ("R2", "REJECTED", 4), ("R2", "ACCEPTED", 5)]
    events = spark.createDataFrame([(r, s, n, "ann") for r, s, n in steps],
                                   "reading_id string, status string, event_no long, actor string").withColumn(
        "event_ts", F.timestamp_seconds("event_no"))
    status = {r.reading_id: r for r in correction.correction_status(events).collect()}
    assert (status["R1"].status, status["R1"].n_illegal) == ("ACCEPTED", 0)
    assert (status["R2"].status, status["R2"].n_illegal) == ("REJECTED", 2)
    view = {r.reading_id: r for r in correction.corrected_view(
        raw, fix, correction.correction_status(events)).collect()}
    assert (view["R1"].temperature, view["R1"].corrected_temperature) == (55.0, 31.8)
    assert view["R2"].corrected_temperature == 54.0
    assert correction.unaudited(events, correction.audit_events(events)).count() == 0


def test_only_flagged_readings_meet_their_diagnosis(spark, monkeypatch):
    rows = [("a", True, 1), ("a", False, 2), ("b", False, 3), ("c", True, 4), (None, True, 5), (None, False, 6)]
    stage = cut(spark.createDataFrame(rows, "reading_id string, anomaly boolean, n int"), "test")
    monkeypatch.setattr(evaluate, "diagnose", lambda df, cfg: df.where("anomaly").select("reading_id", *[
        F.concat(F.lit(c), "reading_id").alias(c) for c in evaluate.DIAGNOSIS]))
    got = evaluate.with_diagnosis(stage)
    want = stage.join(evaluate.diagnose(stage, None), "reading_id", "left")
    assert got.columns == want.columns and sorted(got.collect(), key=lambda r: r["n"]) == sorted(
        want.collect(), key=lambda r: r["n"])
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
