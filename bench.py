"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugewise.operators import correction, faults, features, health, impact, signals, stations as st  # noqa: E402
from gaugewise.plans import evaluate  # noqa: E402
from gaugewise.session import BUILDER_CONF, cut, tune  # noqa: E402
from gaugewise.sources import fixtures as fx  # noqa: E402


def session(cpus: str) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
         .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")))
    for k, v in BUILDER_CONF.items():
        b = b.config(k, v)
    spark = tune(b.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run, repeats: int) -> float:
    times = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = session(cpus)
    r, s = fx.readings(spark, sf), fx.stations(spark, sf)
    cfg = evaluate.fit_config(r)
    # Stages that a production run has on disk already; the full evaluation below is timed without them.
    stage = cut(evaluate.judged(r, s), "judged")
    full = cut(evaluate.with_diagnosis(stage), "evaluated")
    as_of = r.selectExpr("to_date(max(ts)) as as_of").scalar()
    ids = ["reading_id", "station_id", "t", "anomaly", *fx.VARIABLES]
    cases = {
        "evaluate_all": lambda: consume(evaluate.evaluated(r, s)),
        "e10_e12_neighbour_consensus": lambda: consume(st.idw_consensus(r, s, cfg)),
        "f2_rolling_stats": lambda: consume(features.rolling_stats(r, cfg)),
        "f3_zscore": lambda: consume(signals.zscore_signal(r)),
        "f4_rolling_quantiles": lambda: consume(signals.quantile_signal(r)),
        "x3_frozen_runs": lambda: consume(faults.frozen_flags(r, cfg)),
        "c1_interpolation": lambda: consume(correction.with_interpolation(stage.select(*ids))),
        "h6_sensor_health": lambda: consume(health.sensor_health(full, fx.sensors(spark, sf), as_of)),
        "m2_maintenance_queue": lambda: consume(health.maintenance_queue(health.maintenance_priority(
            health.sensor_health(full, fx.sensors(spark, sf), as_of), full, st.neighbours(s, 30.0)))),
        "b1_downsample": lambda: consume(impact.downsample(r)),
    }
    queries = {name: timed(run, repeats) for name, run in cases.items()}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(queries.values()), 3), "unit": "sec",
                      "queries": queries, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
