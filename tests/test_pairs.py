"""Readings paired with their neighbours tile by tile, against the form over a given station graph."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest

from gaugewise.config import DEFAULT, US_PER_DAY, US_PER_HOUR, VARIABLES
from gaugewise.functions import worker
from gaugewise.operators import stations as st


@pytest.fixture(scope="module")
def tables(spark):
    """Stations around the date line, 12 of them on one spot, one listed twice, one without a place; readings with gaps,
    NaN, sentinels, repeats, null ids and null times."""
    rng = random.Random(8)
    spots = [(10.0, 179.95)] * 12 + [(rng.uniform(9.6, 10.4), rng.uniform(179.6, 180.4)) for _ in range(20)]
    spots = [(f"s{i:02d}", lat, lon - 360 if i % 2 else lon) for i, (lat, lon) in enumerate(spots)]
    stations = spark.createDataFrame([*spots, spots[7], ("lost", None, None), (None, 10.0, 179.95)],
                                     "station_id string, latitude double, longitude double")
    rows = []
    for i in range(500):
        values = [rng.choice([None, float("nan"), float("inf"), -9999.0]) if rng.random() < 0.1 else rng.randrange(80) / 8 + base
                  for base in (10, 1000, 50)]
        t = None if i % 50 == 7 else rng.randrange(2 * 24) * US_PER_HOUR + 19_700 * US_PER_DAY
        rows.append((None if i % 90 == 1 else f"r{i}", rng.choice([*(s for s, *_ in spots), "s00", "lost", None]), t, *values))
    rows += rows[:20] + [("r2", *rows[2][1:3], 11.0, 1001.0, 51.0)]
    return spark.createDataFrame(rows, "reading_id string, station_id string, t bigint, temperature double, "
                                       "pressure double, humidity double").cache(), stations


def _rows(df, columns):
    rows = [[f"{x}" if isinstance(x, str) or x is None else x for x in r] for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda r: [x if isinstance(x, str) else f"{x + 0.0:020.5f}" for x in r])


@pytest.mark.parametrize("nearest", [False, True])
def test_pairs_by_tile_equal_those_over_the_graph(spark, tables, nearest, monkeypatch):
    readings, stations = tables
    monkeypatch.setattr(worker.PairScan, "pairs", 700)
    edges = st.neighbours(stations, DEFAULT.radius_km)
    form = st.nearest_neighbours if nearest else st.align_neighbours
    cfg = replace(DEFAULT, tile_us=US_PER_DAY // 2)
    columns = ["reading_id", "station_id", *(["neighbour_id"] if not nearest else []), "t", "km",
               *[f"{p}_{v}" for v in VARIABLES for p in ("own", "an", "as", "ass")]]
    want, got = _rows(form(readings, edges, cfg), columns), _rows(form(readings, None, cfg, stations=stations), columns)
    assert len(got) == len(want) > 1500
    for a, b in zip(got, want):
        assert [x for x in a if isinstance(x, str)] == [x for x in b if isinstance(x, str)]
        assert np.allclose([x for x in a if not isinstance(x, str)], [x for x in b if not isinstance(x, str)], rtol=0, atol=1e-6)


def test_no_row_per_reading_and_neighbour_is_shuffled(spark, tables):
    readings, stations = tables
    for df in (st.align_neighbours(readings, None, stations=stations), st.nearest_neighbours(readings, None, stations=stations)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.index("MapInArrow") < text.index("Exchange"), "nothing is exchanged after the pairs are made"
    far = st.nearest_neighbours(readings, None, told=readings.where("reading_id not like '%3'"), stations=stations)
    near = st.nearest_neighbours(readings, st.neighbours(stations, DEFAULT.radius_km), told=readings.where(
        "reading_id not like '%3'"))
    assert far.count() == near.count() > 0
