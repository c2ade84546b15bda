"""The station graph against all pairs, above all where longitude wraps."""

from __future__ import annotations

import math

from gaugewise.operators.quality import dedupe, exact_quantiles
from gaugewise.operators.stations import neighbours


def km(a, b):
    (la, lo), (lb, lp) = ((math.radians(x) for x in p) for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 12742 * math.asin(min(1, math.sqrt(h)))


def test_pairs_across_the_date_line_the_equator_and_at_the_poles(spark):
    points = [(lat, lon) for lat in (-90.0, -89.9, -75.05, -33.1, -0.05, 0.0, 0.1, 41.7, 60.02, 75.05, 89.7, 89.95, 90.0)
              for lon in (-180.0, -179.95, -179.7, -90.0, -0.1, 0.0, 0.05, 179.7, 179.95, 180.0)]
    points += [(lat + 0.1, lon) for lat, lon in points if -89 < lat < 89]
    stations = spark.createDataFrame([(str(i), *p) for i, p in enumerate(points)],
                                     "station_id string, latitude double, longitude double")
    for radius in (7.0, 30.0):
        got = {(r[0], r[1]) for r in neighbours(stations, radius).collect()}
        want = {(str(i), str(j)) for i, a in enumerate(points) for j, b in enumerate(points)
                if i != j and km(a, b) <= radius}
        assert got == want


def test_dedupe_keeps_rows_without_a_station(spark):
    df = spark.sql("select * from values ('a', 's', timestamp'2024-01-01', 1), ('b', 's', timestamp'2024-01-01', 2), "
                   "('c', null, timestamp'2024-01-01', 3), ('d', null, timestamp'2024-01-01', 4) "
                   "as t(reading_id, station_id, ts, x)")
    assert sorted(r[0] for r in dedupe(df).collect()) == ["a", "c", "d"]


def test_exact_quantiles_equal_interpolated_ones(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    rows = [(k, float(x)) for k, n in (("a", 1), ("b", 2), ("c", 501)) for x in np.round(rng.normal(size=n), 2)]
    df = spark.createDataFrame([*rows, ("c", None)], "k string, x double")
    got = {r["k"]: (r["lo"], r["mid"]) for r in exact_quantiles(df, ["k"], "x", {"lo": 0.1, "mid": 0.5}, 0.5).collect()}
    for key in "abc":
        x = [v for k, v in rows if k == key]
        assert np.allclose(got[key], np.quantile(x, [0.1, 0.5]))


def test_the_consensus_equals_that_over_pairs_and_deals_no_row_per_neighbour(spark):
    import random
    from dataclasses import replace

    import numpy as np
    from pyspark.sql import functions as F

    from gaugewise.config import DEFAULT, US_PER_DAY, US_PER_HOUR
    from gaugewise.operators import stations as st
    rng = random.Random(5)
    # One site of 40 stations, others around it and across the date line; one station stands in the list twice.
    spots = [(10.0, 179.95)] * 40 + [(rng.uniform(9.5, 10.5), rng.uniform(179.5, 180.5)) for _ in range(40)]
    spots = [(f"s{i:02d}", lat, lon - 360 if i % 2 else lon) for i, (lat, lon) in enumerate(spots)]
    stations = spark.createDataFrame([*spots, spots[7], ("lost", None, None)],
                                     "station_id string, latitude double, longitude double")
    rows = []
    for i in range(900):
        values = [rng.choice([None, float("nan"), -9999.0]) if rng.random() < 0.1 else rng.randrange(80) / 8 + base
                  for base in (10, 1000, 50)]
        rows.append((f"r{i}", rng.choice([*(s for s, *_ in spots), "s00", "lost", None]),
                     rng.randrange(3 * 24) * US_PER_HOUR + 19_700 * US_PER_DAY, *values))
    rows += rows[:20] + [("r1", *rows[1][1:3], 11.0, 1001.0, 51.0), ("late", "s00", None, 10.0, 1000.0, 50.0)]
    readings = spark.createDataFrame(rows, "reading_id string, station_id string, t bigint, temperature double, "
                                           "pressure double, humidity double").cache()
    cfg, edges = replace(DEFAULT, tile_us=US_PER_DAY // 2), neighbours(stations, DEFAULT.radius_km)
    order = ["reading_id", "temperature", "pressure", "humidity"]
    for told in (None, readings.where("reading_id not like '%3'")):
        near, far = ([[float("nan") if v is None else v for v in r[1:]] for r in st.with_consensus(readings, stations, cfg, edges=e, told=told).select(
                          *order, *[f"{c}_{v}" for v in order[1:] for c in ("idw", "nn", "agree", "spread")])
                      .orderBy(*order).collect()] for e in (None, edges))
        assert len(near) == len(far) and sum(r[3] == r[3] for r in near) > 500
        assert np.allclose(near, far, rtol=0, atol=1e-6, equal_nan=True)
    met = st.dealt(readings, stations, replace(DEFAULT, tile_us=7 * US_PER_DAY))
    asks = readings.join(edges, "station_id")
    assert met.count() < 4 * readings.count() < asks.count() / 2
    assert met.where("_ask").count() == readings.join(stations.where("latitude is not null").distinct(), "station_id").where(
        "t is not null").count()
    assert met.agg(F.max("_times")).first()[0] == 2
