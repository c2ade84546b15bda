"""Missing, NaN, infinite and impossible values stay with their own reading; exact rolling quantiles over counted chunks."""

from __future__ import annotations

import time
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewise.config import DEFAULT, US_PER_DAY, US_PER_HOUR
from gaugewise.functions import worker
from gaugewise.operators import decision, signals, stations as st
from gaugewise.plans import evaluate
from gaugewise.session import cut
from gaugewise.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
WEEK = DEFAULT.hist_window_us


def with_values(spark, bad):
    """The readings with the values of one in 40 replaced."""
    rows, hit = fx.readings(spark, SF), F.col("seq") % 40 == 11
    return cut(rows.withColumns({v: F.when(hit, F.lit(bad).cast("double")).otherwise(F.col(v))
                                 for v in ("temperature", "humidity")}), "broken-test")


@pytest.fixture(scope="module")
def judged(spark):
    out = {}
    for name, bad in (("missing", None), ("nan", float("nan")), ("sentinel", -9999.0)):
        rows = evaluate.evaluated(with_values(spark, bad), fx.stations(spark, SF)).collect()
        out[name] = {r.reading_id: r for r in rows}
    return out


@pytest.mark.parametrize("kind", ["nan", "sentinel"])
def test_broken_values_change_no_other_reading(judged, kind):
    """Other readings come out as if the broken ones were missing, on whole decisions."""
    same = ("anomaly", "decision", "trust_score", "fault_type", "explanation", "suggested_value")
    for i, r in judged[kind].items():
        if r.seq % 40 != 11:
            want = judged["missing"][i]
            assert {c: r[c] for c in same} == {c: want[c] for c in same}, i


@pytest.mark.parametrize("kind", ["missing", "nan", "sentinel"])
def test_no_broken_reading_is_trusted(judged, kind):
    broken = [r for r in judged[kind].values() if r.seq % 40 == 11 or r.temperature is None]
    assert len(broken) > 20 and all(r.anomaly and r.trust_score < 50 for r in broken)
    if kind == "sentinel":
        own = [r for r in broken if r.seq % 40 == 11]
        assert all(r.decision == "sensor_fault" and r.trust_score == 0 for r in own)
        assert all(any("outside its physical limits" in s for s in r.explanation) for r in own)


def test_trusted_gate_keeps_no_broken_reading(spark):
    rows = evaluate.judged(fx.broken_readings(spark, SF), fx.stations(spark, SF))
    values = [f"{v} is null or {v} not between {lo} and {hi}" for v, (lo, hi) in DEFAULT.bounds.items()]
    assert rows.where(" or ".join(values)).count() > 50
    assert decision.trusted(rows, 50).where(" or ".join(values)).count() == 0


def test_consensus_without_the_broken_values(spark):
    stations = fx.stations(spark, SF)
    columns = ["reading_id", "variable", "idw", "n_neighbours", "spread"]
    found = [sorted(map(tuple, st.idw_consensus(with_values(spark, bad), stations).select(*columns).collect()))
             for bad in (None, float("nan"), -9999.0)]
    assert found[0] == found[1] == found[2] and all(r[2] is None or np.isfinite(r[2]) for r in found[0])


# --- rolling quantiles


def brute_quantiles(rows, qs, least):
    out = {}
    for i, s, t, *xs in rows:
        frame = [r for r in rows if r[1] == s and t - WEEK <= r[2] < t]
        out[i] = []
        for v, (lo, hi) in enumerate(DEFAULT.bounds.values()):
            own = [r[3 + v] for r in frame if r[3 + v] is not None and lo <= r[3 + v] <= hi]
            out[i] += [float(np.quantile(own, q)) if len(own) >= least else None for q in qs]
    return out


@pytest.mark.parametrize("hours", [168, 84, 24, 6])
def test_quantiles_equal_brute_force(spark, hours):
    rng = np.random.default_rng(hours)
    rows = []
    for i in range(700):
        t = 1_704_067_200_000_000 + int(rng.integers(-30, 30)) * US_PER_DAY // 3 + int(rng.integers(0, 9)) * 1_000_000
        xs = [float(np.round(rng.normal(20, 5), rng.integers(0, 3))), float(rng.integers(900, 905)), float(rng.uniform(0, 100))]
        xs[int(rng.integers(3))] = rng.choice([None, -9999.0, float("nan"), float("inf"), 7.0])
        rows.append((f"r{i}", "hot" if i % 2 else f"s{i % 6}", t, *xs))
    df = spark.createDataFrame(rows, "reading_id string, station_id string, t long, temperature double, pressure double, "
                                     "humidity double")
    got = signals.with_rolling_quantiles(df, replace(DEFAULT, quantile_us=hours * US_PER_HOUR, min_hist=3)).collect()
    want = brute_quantiles(rows, (0.05, 0.25, 0.75, 0.95), 3)
    assert len(got) == len(rows)
    for r in got:
        mine = [r[f"{q}_{v}"] for v in DEFAULT.bounds for q in ("q_lo", "q25", "q75", "q_hi")]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(mine, want[r.reading_id]))


def test_nth_ranks_equal_sorting():
    rng = np.random.default_rng(3)
    ranks, heavy = rng.integers(0, 37, 500), rng.integers(0, 37, 40)
    weights = rng.integers(1, 5, 40)
    lo = rng.integers(0, 250, 200)
    hi = lo + rng.integers(1, 250, 200)
    a, b = np.zeros(200, int), rng.integers(0, 41, 200)
    n = np.array([rng.integers(0, hi[i] - lo[i] + weights[:b[i]].sum()) for i in range(200)])
    got = worker.nth_ranks([worker.Sequence(ranks, 6), worker.Sequence(heavy, 6, weights)], [(lo, hi), (a, b)], n, 6)
    for i in range(200):
        own = np.sort(np.concatenate((ranks[lo[i]:hi[i]], np.repeat(heavy[:b[i]], weights[:b[i]]))))
        assert got[i] == own[n[i]]


def test_a_busy_station_week_in_bounded_time():
    """200,000 readings of one station in a week, and as many in the week before: seconds, not rows x frame."""
    n = 200_000
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=2 * n), 3)
    t = np.concatenate((np.sort(rng.integers(0, WEEK, n)), np.sort(rng.integers(WEEK, 2 * WEEK, n))))
    rows = pa.StructArray.from_arrays([pa.array(t)], ["t"])
    table = pa.table({"station_id": pa.array(["hot"] * 2 * n), "_c": np.ones(2 * n, np.int64), "_kind": np.repeat(
        [1, 2], n), "t": t, "_u_a": x, "_v": np.full(2 * n, -1), "_n": np.zeros(2 * n, np.int64), "_row": rows})
    scan = worker.QuantileScan(("a",), (0.05, 0.5), WEEK, WEEK, 8, ["lo", "mid"])
    began = time.time()
    out = pa.Table.from_batches(list(scan(iter(table.to_batches(max_chunksize=10_000)))))
    assert time.time() - began < 60 and out.num_rows == n
    for i in (0, 1, n // 3, n - 1):
        frame = x[(t >= t[n + i] - WEEK) & (t < t[n + i])]
        assert out["mid"][i].as_py() == pytest.approx(np.quantile(frame, 0.5), abs=1e-12)
