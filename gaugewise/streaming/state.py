"""Custom stateful operators. State is a few numbers per sensor, kept in the RocksDB store."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACK_SCHEMA = ("station_id string, variable string, reading_id string, t bigint, x double, late boolean, "
                "run_length bigint, rate double, z double")
TRACK_STATE = ("last double, last_t bigint, run bigint, n bigint, mean double, m2 double, newest bigint, "
               "waiting array<struct<t: bigint, reading_id: string, x: double>>")
TRACKED = Row(*[c.split()[0] for c in TRACK_SCHEMA.split(", ")])
SILENT_SCHEMA = "station_id string, last_t bigint, n bigint, limit_us bigint"
SILENT_STATE = "first_t bigint, last_t bigint, n bigint, timer bigint"


class TrackSensor(StatefulProcessor):
    """Run length of equal values, rate per minute and z-score against all earlier values of a sensor (Welford moments),
    without rescanning its history.

    State only goes forward in event time: readings wait in a buffer until the sensor's newest one is ``delay_us`` ahead
    of them, and leave it in order. One that comes after its place has been passed is late: it is reported, with nothing
    but its value, and changes no state. So any arrival order within the delay gives the same rows.

    Rows pass one by one and a sensor's state is read once and written once: with many sensors of few rows each, a data
    frame per sensor and every further call to the state store cost more than the tracking."""

    def __init__(self, min_rows: int, std_floor: float, delay_us: int) -> None:
        self.min_rows, self.std_floor, self.delay_us = min_rows, std_floor, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sensor", TRACK_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r.t, r.reading_id, r.x) for r in rows]
        last, last_t, run, n, mean, m2, newest, held = self.state.get() or (None, None, 0, 0, 0.0, 0.0, None, ())
        passed = None if newest is None else newest - self.delay_us
        for t, i, x in new:
            if passed is not None and t <= passed:
                yield TRACKED(*key, i, t, x, True, None, None, None)
        waiting = sorted([*map(tuple, held), *(r for r in new if passed is None or r[0] > passed)])
        newest = max([t for t, *_ in new] + ([] if newest is None else [newest]))
        ready = bisect_right(waiting, newest - self.delay_us, key=itemgetter(0))
        for t, reading_id, x in waiting[:ready]:
            run = run + 1 if last is not None and x == last else 1
            rate = (x - last) / ((t - last_t) / 6e7) if last is not None and t > last_t else None
            std = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
            z = (x - mean) / std if n >= self.min_rows and std > self.std_floor else None
            yield TRACKED(*key, reading_id, t, x, False, run, rate, z)
            n += 1
            step = x - mean
            mean += step / n
            m2 += step * (x - mean)
            last, last_t = x, t
        self.state.update((last, last_t, run, n, mean, m2, newest, waiting[ready:]))

    def close(self) -> None:
        pass


class SilentStation(StatefulProcessor):
    """Reports a station once no reading came for ``factor`` x its mean gap, by an event-time timer."""

    def __init__(self, factor: float) -> None:
        self.factor = factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("station", SILENT_STATE)

    def _limit(self, first: int, last: int, n: int) -> int:
        return int(self.factor * (last - first) / (n - 1))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, last, n, timer = self.state.get() if self.state.exists() else (None, None, 0, None)
        for pdf in rows:
            n += len(pdf)
            low, high = int(pdf["t"].min()), int(pdf["t"].max())
            first = low if first is None else min(first, low)
            last = high if last is None else max(last, high)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None
        if n > 1:
            timer = (last + self._limit(first, last, n)) // 1000 + 1
            self.handle.registerTimer(timer)
        self.state.update((first, last, n, timer))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        first, last, n, _ = self.state.get()
        self.state.update((first, last, n, None))
        yield pd.DataFrame({"station_id": [key[0]], "last_t": [last], "n": [n],
                            "limit_us": [self._limit(first, last, n)]})

    def close(self) -> None:
        pass


def _with_rocksdb(df: DataFrame) -> DataFrame:
    import sys
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return df


def track_sensors(obs: DataFrame, min_rows: int = 8, std_floor: float = 1e-5, delay_us: int = 3_600_000_000) -> DataFrame:
    """Stream of long observations (station_id, variable, reading_id, t, x) to tracked rows, ``late`` ones among them."""
    present = _with_rocksdb(obs).where("x is not null and not isnan(x)").select(
        "station_id", "variable", "reading_id", "t", "x")
    return present.groupBy("station_id", "variable").transformWithState(
        TrackSensor(min_rows, std_floor, delay_us), TRACK_SCHEMA, "Append", "None")


def silent_stations(stream: DataFrame, factor: float = 4.0, delay: str = "1 hour") -> DataFrame:
    rows = _with_rocksdb(stream).select("station_id", "ts", "t").withWatermark("ts", delay)
    return rows.groupBy("station_id").transformWithStateInPandas(
        SilentStation(factor), SILENT_SCHEMA, "Append", "EventTime")
