"""Contract payloads, boundary and negative paths of ingestion."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gaugewise.operators import decision, quality as q, signals
from gaugewise.sources import io

OK = {"station_id": "AWS-104", "timestamp": "2026-09-04T10:00:00", "temperature": 31.2, "pressure": 1004.1,
      "humidity": 48.2}


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "raw_payload string")


def test_canonical_payload_passes(spark):
    good, bad = q.split_malformed(payloads(spark, json.dumps(OK)))
    row = q.check_humidity(q.normalise_ts(good.select("decoded.*"))).first()
    assert bad.count() == 0 and row.humidity_ok
    assert row.t == 1788516000000000
    assert q.check_required(q.normalise_ts(good.select("decoded.*"))).first().complete


@pytest.mark.parametrize("field", list(OK))
def test_each_required_field_is_checked(spark, field):
    text = json.dumps({k: v for k, v in OK.items() if k != field})
    good, _ = q.split_malformed(payloads(spark, text))
    row = q.check_required(q.normalise_ts(good.select("decoded.*"))).first()
    assert row.missing_fields == ["ts" if field == "timestamp" else field] and not row.complete


def test_malformed_payloads_are_quarantined(spark):
    wrong = json.dumps(OK | {"pressure": "high"})
    good, bad = q.split_malformed(payloads(spark, json.dumps(OK), wrong, '{"station_id": "A', "plain text"))
    assert (good.count(), bad.count()) == (1, 3)


@pytest.mark.parametrize("humidity,ok", [(0.0, True), (100.0, True), (-0.1, False), (100.1, False)])
def test_humidity_boundaries(spark, humidity, ok):
    assert q.check_humidity(spark.createDataFrame([(humidity,)], "humidity double")).first().humidity_ok is ok


def test_timestamps(spark):
    texts = ["2026-09-04T10:00:00Z", "2026-09-04T12:00:00+02:00", "2026-09-04T10:00:00", "soon"]
    out = [r.t for r in q.normalise_ts(spark.createDataFrame([(t,) for t in texts], "timestamp string")).collect()]
    assert out[0] == out[1] == out[2] == 1788516000000000 and out[3] is None


def test_ensemble_of_the_canonical_signals(spark):
    row = spark.createDataFrame([(20.0, 1000.0, 50.0, 0.91, 0.96, 0.95)],
                                "temperature double, pressure double, humidity double, statistical double, "
                                "isolation_forest double, autoencoder double")
    out = signals.ensemble(row).first()
    assert out.anomaly and out.anomaly_score == pytest.approx(0.94)
    assert out.signals.isolation_forest == 0.96


def test_adapter_checks_the_scorer(spark):
    df = spark.createDataFrame([("R1", "S", 1, 1.0, 2.0, 3.0)],
                               "reading_id string, station_id string, t long, temperature double, pressure double, "
                               "humidity double")
    with pytest.raises(ValueError):
        signals.adapt(df, lambda d: d.select("reading_id"), "x", 0.5)
    out = signals.adapt(df, lambda d: d.select("reading_id", F.lit(1.7).alias("score")), "x", 0.5).first()
    assert out.anomaly_score is None and out.anomaly is False


def test_trust_grows_with_genuineness_and_is_no_inverse_of_the_anomaly_score(spark):
    grid = spark.createDataFrame([(a / 20, g / 20) for a in range(21) for g in range(21)], "a double, g double")
    trust = lambda coverage: decision.calculate_trust_score(F.col("a"), F.col("g"), F.lit(coverage))
    rows = grid.withColumns({"trust": trust(1.0), "thin": trust(0.1)}).collect()
    table = {(round(r.a * 20), round(r.g * 20)): r.trust for r in rows}
    assert all(0 <= v <= 100 for v in table.values())
    assert all(table[a, g] <= table[a, g + 1] for a in range(21) for g in range(20))
    assert table[19, 19] > 90 and table[19, 2] < 20
    assert all(r.thin <= r.trust for r in rows), "what no evidence covers corroborates nothing"
    assert max(r.thin for r in rows if r.a == 1.0) == 10


def test_evidence_weights_follow_present_evidence(spark):
    w = {"temporal": 0.25, "cross_sensor": 0.25, "cross_station": 0.4, "persistence": 0.1}
    df = spark.createDataFrame([(1.0, None, 0.5, 0.0), (None, None, None, None)],
                               "temporal double, cross_sensor double, cross_station double, persistence double")
    out = df.select(decision.genuineness({n: F.col(n) for n in w}, w).alias("g")).collect()
    assert out[0].g == pytest.approx((0.25 + 0.2 + 0.1) / 0.75) and out[1].g is None


def test_appending_raw_readings_changes_nothing(spark, tmp_path):
    rows = [("R1", "S", 20.0), ("R2", "S", 21.0)]
    df = spark.createDataFrame(rows, "reading_id string, station_id string, temperature double").withColumn(
        "ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    io.append_raw(df, str(tmp_path / "raw"))
    before = spark.read.parquet(str(tmp_path / "raw"))
    snapshot = before.toPandas()
    io.append_raw(df.withColumn("reading_id", F.concat("reading_id", F.lit("x"))), str(tmp_path / "raw"))
    after = spark.read.parquet(str(tmp_path / "raw"))
    assert q.raw_diff(spark.createDataFrame(snapshot), after).count() == 0
    assert after.count() == 4
