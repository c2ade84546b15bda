"""The chunked building blocks against brute force, with a hot key, ties, gaps and times before 1970."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gaugewise.operators import timeline as tl

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for i in range(900):
        key = "hot" if i % 3 else f"k{i % 7}"
        t = rnd.randrange(-40 * HOUR, 60 * HOUR, HOUR // 4)
        out.append((f"r{i:04d}", key, t, None if i % 11 == 0 else float(rnd.randrange(0, 40)) / 8))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "reading_id string, key string, t long, x double")


def ordered(rows, key):
    return sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))


def test_rolling_sums_equal_brute_force(frame, rows):
    out = tl.rolling_sums(frame, ["key"], "t", ["x"], {
        "n": ("if(x is null, 0, 1)", 6 * HOUR), "s": ("x", 6 * HOUR), "s2": ("x", 2 * HOUR)}, 2 * HOUR).collect()
    assert len(out) == len(rows)
    for r in out:
        inside = lambda w: [b[3] for b in rows if b[1] == r.key and r.t - w <= b[2] < r.t and b[3] is not None]
        assert r.n == len(inside(6 * HOUR))
        assert r.s == pytest.approx(sum(inside(6 * HOUR)))
        assert r.s2 == pytest.approx(sum(inside(2 * HOUR)))


def test_rolling_sums_reject_partial_buckets(frame):
    with pytest.raises(ValueError):
        tl.rolling_sums(frame, ["key"], "t", ["x"], {"s": ("x", 5)}, 2)


@pytest.mark.parametrize("bucket", [None, HOUR, HOUR // 4, 3 * HOUR // 180])
def test_around_sums_equal_brute_force(frame, rows, bucket):
    events = frame.select("key", "t", "x")
    out = tl.around_sums(frame.select("key", "t", "reading_id"), events, ["key"], "t", 3 * HOUR,
                         {"n": "if(x is null, 0, 1)", "s": "x"}, bucket).collect()
    assert len(out) == len(rows)
    for r in out:
        near = [b[3] for b in rows if b[1] == r.key and abs(b[2] - r.t) <= 3 * HOUR and b[3] is not None]
        assert (r.n, r.s) == (len(near), pytest.approx(sum(near)))


@pytest.mark.parametrize("chunk", [400 * HOUR, 5 * HOUR, HOUR // 4])
def test_seen_around_equals_brute_force(spark, frame, rows, chunk):
    """Events without a value are not seen; probes ask at times of events, between them, before and after all."""
    times = sorted({r[2] + d for r in rows[::3] for d in (0, 7)} | {-900 * HOUR, 900 * HOUR})
    probes = spark.createDataFrame([(f"{k}:{t}", k, t) for k in ("hot", "k0", "k3", "none") for t in times],
                                   "probe string, key string, t long")
    out = tl.seen_around(probes, frame, "key", "t", chunk, {"x": "x", "tall": "if(x > 3, x, null)"}, "reading_id").collect()
    assert len(out) == 4 * len(times)
    for r in out:
        for name, least in (("x", -1), ("tall", 3)):
            own = [b for b in rows if b[1] == r.key and b[3] is not None and b[3] > least]
            before = max(((b[2], b[0], b[3]) for b in own if b[2] <= r.t), default=None)
            after = min(((b[2], b[0], b[3]) for b in own if b[2] >= r.t), key=lambda b: b[0], default=None)
            if after:
                after = max((b[2], b[0], b[3]) for b in own if b[2] == after[0])
            assert (r[f"_p_{name}"] and tuple(r[f"_p_{name}"])) == before
            assert (r[f"_n_{name}"] and tuple(r[f"_n_{name}"])) == after


def test_adjacent_windows_cross_chunks(frame, rows):
    out = tl.with_adjacent(frame, ["key"], ["t", "reading_id"], 3, F.floor(F.col("t") / (4 * HOUR)), lambda w: {
        "prev": F.lag("reading_id").over(w), "next": F.lead("reading_id").over(w),
        "block": F.collect_list("reading_id").over(w.rowsBetween(-3, 3))}).collect()
    assert len(out) == len(rows)
    for key in {r[1] for r in rows}:
        ids = [r[0] for r in ordered(rows, key)]
        for r in (r for r in out if r.key == key):
            i = ids.index(r.reading_id)
            assert r.prev == (ids[i - 1] if i else None)
            assert r.next == (ids[i + 1] if i + 1 < len(ids) else None)
            assert r.block == ids[max(0, i - 3):i + 4]


@pytest.mark.parametrize("descending", [False, True])
def test_running_aggregates_cross_chunks(frame, rows, descending):
    out = tl.running(frame, ["key"], ["t", "reading_id"], F.floor(F.col("t") / (4 * HOUR)), {
        "n": ("sum", F.lit(1), True), "before": ("sum", F.col("x"), False), "top": ("max", F.col("x"), True)},
        descending=descending).collect()
    assert len(out) == len(rows)
    for key in {r[1] for r in rows}:
        seq = ordered(rows, key)[::-1 if descending else 1]
        ids = [r[0] for r in seq]
        for r in (r for r in out if r.key == key):
            i = ids.index(r.reading_id)
            earlier = [b[3] for b in seq[:i] if b[3] is not None]
            upto = [b[3] for b in seq[:i + 1] if b[3] is not None]
            assert r.n == i + 1
            assert (r.before or 0.0) == pytest.approx(sum(earlier))
            assert r.top == (max(upto) if upto else None)


def test_lookup_spreads_a_hot_key(spark, frame, rows):
    small = spark.createDataFrame([("hot", 1), ("k0", 2)], "key string, label int")
    out = tl.lookup(frame, small, ["key"], 4).collect()
    assert len(out) == len(rows)
    assert {(r.key, r.label) for r in out if r.key in ("hot", "k0", "k3")} == {("hot", 1), ("k0", 2), ("k3", None)}


def test_non_finite_values_leave_later_windows_alone(spark):
    rows = [("a", i * 1_000_000, float("nan") if i == 5 else float("inf") if i == 7 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    out = tl.rolling_sums(df, ["k"], "t", ["x"], {
        "n": ("if(x is null, 0, 1)", 10_000_000), "s": ("x", 10_000_000)}, 5_000_000).orderBy("t").collect()
    for i, r in enumerate(out):
        frame = [j for j in range(max(0, i - 10), i) if j not in (5, 7)]
        assert (r["n"], r["s"]) == (len(frame), sum(frame))
        assert repr(r["x"]) == repr(rows[i][2])
