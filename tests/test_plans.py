"""Plan shape, and independence of results from the physical layout."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gaugewise import session
from gaugewise.config import DEFAULT, US_PER_HOUR
from gaugewise.operators import evidence, faults, features, health, signals, stations as st
from gaugewise.plans import evaluate
from gaugewise.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("build", [
    lambda r, s: st.idw_consensus(r, s),
    lambda r, s: st.asof_neighbours(r, st.neighbours(s, 30.0)),
    lambda r, s: evidence.temporal_evidence(r),
    lambda r, s: faults.frozen_flags(r),
    lambda r, s: signals.quantile_signal(r),
])
def test_no_nested_loops(spark, build):
    text = plan(build(fx.readings(spark, SF), fx.stations(spark, SF)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ordered_work_is_partitioned_below_the_station(spark):
    text = plan(features.rolling_stats(fx.readings(spark, SF)))
    events = [line for line in text.splitlines() if "Exchange hashpartitioning(station_id" in line and "REPARTITION" in line]
    assert events and all("_b#" in line for line in events)


def test_projection_reaches_the_scan(spark):
    text = plan(health.degradation(fx.readings(spark, SF).selectExpr(
        "station_id", "ts", "cast(null as string) as decision")))
    schema = next(line for line in text.splitlines() if "ReadSchema" in line).split("ReadSchema:")[1]
    assert "user_id" in schema and "props" not in schema and "value" not in schema


def test_layout_follows_the_busiest_station():
    small = DEFAULT.sized_for(60, 0.001, 200)
    hot = DEFAULT.sized_for(400_000_000, 0.33, 10_000)
    assert small.chunk_us == 24 * US_PER_HOUR and small.quantile_us == DEFAULT.hist_window_us and small.salts == 1
    assert small.align_us == DEFAULT.time_tol_us
    assert hot.salts == 6600, "a third of all rows needs as many salts as it has fair shares"
    for span, chunk in ((DEFAULT.bucket_us, hot.chunk_us), (DEFAULT.hist_window_us, hot.quantile_us),
                        (DEFAULT.time_tol_us, hot.align_us), (DEFAULT.bucket_us, hot.bucket_us)):
        assert span % chunk == 0 and 400_000_000 * chunk <= 2_000_000 * US_PER_HOUR
    assert DEFAULT.sized_for(400_000_000_000, 1.0, 200).chunk_us == 1_000_000


def test_a_station_with_half_of_all_readings_spreads(spark):
    """Chunks fitted to the data hold a bounded number of its rows, in every layout that orders or joins them."""
    rows = spark.range(20_000).selectExpr(
        "concat('R', id) as reading_id", "if(id % 2 = 0, 'hot', concat('S', id % 50)) as station_id",
        "1704067200000000 + id * 8640000 as t", "20D + id % 7 as temperature", "1000D as pressure", "50D as humidity",
        "timestamp_micros(1704067200000000 + id * 8640000) as ts", "cast(null as double) as wind_speed")
    stations = spark.createDataFrame([("hot", 50.0, 8.0)] + [(f"S{i}", 50.0 + i / 500, 8.0) for i in range(1, 50, 2)],
                                     "station_id string, latitude double, longitude double")
    cfg = evaluate.fit_config(rows, replace(DEFAULT, max_rows_per_task=500), stations)
    for chunk in (cfg.chunk_us, cfg.quantile_us, cfg.align_us):
        assert rows.groupBy("station_id", F.floor(F.col("t") / chunk)).count().agg(F.max("count")).first()[0] <= 500
    edges = st.neighbours(stations, cfg.radius_km)
    asks = rows.join(edges, "station_id").groupBy("neighbour_id", F.floor(F.col("t") / cfg.align_us)).count()
    assert asks.agg(F.max("count")).first()[0] <= 500
    found = st.nearest_neighbours(rows, edges, cfg)
    assert found.count() == st.nearest_neighbours(rows, edges).count()


def test_results_do_not_depend_on_the_layout(spark):
    r, s = fx.readings(spark, SF), fx.stations(spark, SF)
    fine = replace(DEFAULT, chunk_us=US_PER_HOUR, bucket_us=US_PER_HOUR, align_us=US_PER_HOUR // 4,
                   quantile_us=24 * US_PER_HOUR, salts=5)
    columns = ["reading_id", "anomaly", "decision", "trust_score", "fault_type", "explanation"]
    a = sorted(map(tuple, evaluate.evaluated(r, s, DEFAULT).select(*columns).collect()), key=lambda x: x[0])
    b = sorted(map(tuple, evaluate.evaluated(r, s, fine).select(*columns).collect()), key=lambda x: x[0])
    assert a == b


def test_written_stages_go_after_their_last_reader(spark, tmp_path):
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    kept, gone = session.cut(rows.repartition("k"), "kept"), session.cut(rows.groupBy("k").count(), "gone")
    rows.write.parquet(str(tmp_path / "input"))
    session.discard(gone, spark.read.parquet(str(tmp_path / "input")), session.cut(rows.limit(0), "empty"))
    assert kept.count() == 100 and spark.read.parquet(str(tmp_path / "input")).count() == 100
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        gone.collect()
    assert spark.conf.get(session.FREE_SHUFFLES, "false") == "false"
