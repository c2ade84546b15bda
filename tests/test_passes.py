"""The evaluation in passes over the stations, and which written stages stay behind."""

from __future__ import annotations

import glob
import os
from dataclasses import replace

from pyspark.sql import functions as F

from gaugewise.config import DEFAULT, US_PER_HOUR
from gaugewise.plans import evaluate
from gaugewise.session import cut, noted, work_dir


def _readings(spark):
    """Twelve stations, one of them without a name, with spikes, gaps, stuck values and a reading_id that two share."""
    rows = spark.range(1200).selectExpr(
        "if(id in (3, 44), 'twin', concat('R', id)) as reading_id",
        "if(id % 12 = 11, null, concat('S', id % 12)) as station_id",
        f"1704067200000000 + (id div 12) * {US_PER_HOUR} as t",
        "case when id % 41 = 3 then null when id % 37 = 5 then 55D when id % 12 = 4 then 21D else 20D + id % 7 end as temperature",
        "1000D + id % 3 as pressure", "if(id % 53 = 0, double('nan'), 50D + id % 5) as humidity")
    return cut(rows.withColumns({"ts": F.timestamp_micros("t"), "wind_speed": F.lit(None).cast("double")}), "given")


def test_passes_give_what_one_pass_gives_and_spent_stages_go(spark):
    readings = _readings(spark)
    stations = spark.createDataFrame([(f"S{i}", 50.0 + i / 20, 8.0) for i in range(11)],
                                     "station_id string, latitude double, longitude double")
    columns = ["t", "station_id", "reading_id", "anomaly", "decision", "trust_score", "fault_type", "suggested_value"]
    seen, before = [], set(os.listdir(work_dir(spark)))
    for most in (8_000_000, 700):
        done = evaluate.evaluated(readings, stations, replace(DEFAULT, rows_per_pass=most))
        seen.append(sorted(map(repr, done.select(*columns).collect())))
    assert seen[0] == seen[1] and len(seen[0]) > 1200
    left = sorted(x.split("-")[0] for x in {*os.listdir(work_dir(spark))} - before)
    assert left == sorted(2 * ["judged", "found", "shared"])


def test_a_pass_is_written_before_the_next_begins_and_holds_whole_stations(spark):
    readings, sizes = _readings(spark), []
    with noted() as stages:
        evaluate.by_station([readings], lambda rows: rows.repartition("t").withColumn("n", F.lit(len(sizes))), "pass", 1)
        evaluate.by_station([readings], lambda rows: (sizes.append(0), rows.withColumn("n", F.lit(len(sizes))))[1], "pass", 4)
    one, four = stages
    assert sorted(map(repr, four.drop("n").collect())) == sorted(map(repr, one.drop("n").collect()))
    assert four.groupBy("station_id").agg(F.countDistinct("n").alias("passes")).where("passes > 1").isEmpty()
    assert len(sizes) == 4 and four.select("n").distinct().count() > 2
    files = glob.glob(f"{work_dir(spark)}/pass-*/*.parquet")
    assert len({os.path.basename(f).split("-", 2)[2] for f in files}) >= 4
    assert evaluate.passes_for(readings, replace(DEFAULT, rows_per_pass=300)) == 4 and evaluate.passes_for(readings) == 1
