"""Labelled data: deterministic fault injection into copies of readings, splits and run registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugewise.config import US_PER_DAY, Config, DEFAULT
from gaugewise.operators.quality import day_chunk
from gaugewise.operators.timeline import lookup, running

# Default fault sizes.
SIZES = {"temperature_spike": 30.0, "temperature_drift": 0.5, "abrupt_jump": 8.0, "bias": 4.0, "noise": 6.0}
EPISODES = {"frozen_sensor": 10, "dropout": 5}


def picked(number: Column, every: int, seed: int) -> Column:
    """Deterministic choice of one in ``every`` by integer arithmetic; no shuffle, no randomness."""
    return F.pmod(number * 7919 + seed, F.lit(every)) == 0


def by_hash(column: str) -> Column:
    """A number for ``picked`` when the id is not numeric."""
    return F.pmod(F.xxhash64(column), F.lit(2_147_483_647))


def _labelled(df: DataFrame, kind: str, hit: Column, variable: str, value: Column) -> DataFrame:
    return df.withColumns({
        "original_value": F.col(variable), "injected": hit,
        "fault_type": F.when(hit, F.lit(kind)),
        variable: F.when(hit, value).otherwise(F.col(variable))})


def _station_onset(df: DataFrame, station_hit: Column, cfg: Config) -> DataFrame:
    """Fault onset per chosen station: the middle of its own time span."""
    span = df.where(station_hit).groupBy("station_id").agg(
        F.expr("min(t) + (max(t) - min(t)) div 2").alias("onset"))
    return lookup(df, span, ["station_id"], cfg.salts)


def inject(df: DataFrame, kind: str, every: int = 100, seed: int = 0, number: Column | None = None,
           station: Column | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """A labelled copy of ``df`` with one kind of fault; the input is never changed.

    ``number`` numbers readings and ``station`` numbers stations for the choice. Point faults choose
    one reading in ``every``; drift, jump, bias choose one station in ``every``; frozen and dropout
    choose readings that start an episode of fixed length.
    """
    number = by_hash("reading_id") if number is None else number
    station = by_hash("station_id") if station is None else station
    hit = picked(number, every, seed)
    size = F.lit(SIZES.get(kind, 0.0))
    x = F.col("temperature")
    if kind == "temperature_spike":
        return _labelled(df, kind, hit, "temperature", x + size)
    if kind == "noise":
        unit = F.pmod(number * 104_729 + seed, F.lit(10_001)) / 5000.0 - 1
        return _labelled(df, kind, hit, "temperature", x + size * unit)
    if kind == "multivariate_inconsistency":
        return _labelled(df, kind, hit, "humidity", 160.0 - F.col("humidity"))
    if kind == "bias":
        return _labelled(df, kind, picked(station, every, seed), "temperature", x + size)
    if kind in ("temperature_drift", "abrupt_jump"):
        out = _station_onset(df, picked(station, every, seed), cfg)
        after = F.coalesce(F.col("t") >= F.col("onset"), F.lit(False))
        days = (F.col("t") - F.col("onset")) / F.lit(float(US_PER_DAY))
        value = x + size * days if kind == "temperature_drift" else x + size
        return _labelled(out, kind, after, "temperature", value).drop("onset")
    if kind in EPISODES:
        return _episode(df, kind, hit, EPISODES[kind], cfg)
    raise ValueError(f"unknown fault kind {kind!r}")


def _episode(df: DataFrame, kind: str, start: Column, rows: int, cfg: Config) -> DataFrame:
    """Hold the value (or drop it) for ``rows`` readings of the station from each start on."""
    order, keys = ["t", "reading_id"], ["station_id"]
    out = running(df, keys, order, day_chunk(cfg), {"_seq": ("sum", F.lit(1), True)})
    begun = F.when(start, F.struct(F.col("_seq").alias("seq"), F.col("temperature").alias("x")))
    out = running(out, keys, order, day_chunk(cfg), {"_from": ("max", begun, True)})
    inside = F.coalesce(F.col("_seq") - F.col("_from.seq") < rows, F.lit(False))
    value = F.col("_from.x") if kind == "frozen_sensor" else F.lit(None).cast("double")
    return _labelled(out, kind, inside, "temperature", value).drop("_seq", "_from")


def benchmark_set(clean: DataFrame, injected: list[DataFrame]) -> DataFrame:
    """Clean rows plus the injected rows of each faulty copy, with labels."""
    out = clean.withColumns({"original_value": F.col("temperature"), "injected": F.lit(False),
                             "fault_type": F.lit(None).cast("string")})
    for df in injected:
        out = out.unionByName(df.where("injected").select(*out.columns))
    return out


def split(df: DataFrame, train_until: Column, valid_until: Column, holdout: Column) -> DataFrame:
    """Assign train / valid / test by time, and whole stations to ``holdout``; splits cannot overlap."""
    return df.withColumn("split", F.when(holdout, "holdout").when(F.col("ts") < train_until, "train")
                         .when(F.col("ts") < valid_until, "valid").otherwise("test"))


def leaks(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Keys that occur in both splits; empty when the split is clean."""
    left = df.where(F.col("split") == a).select(key).distinct()
    return left.join(df.where(F.col("split") == b).select(key), key, "left_semi")


def best_run(runs: DataFrame, metric: str) -> DataFrame:
    """The run with the highest metric; ties go to the smallest run id."""
    return runs.groupBy("experiment").agg(
        F.max_by("run_id", F.struct(F.col(metric), -F.col("run_no"))).alias("best_run"),
        F.max(metric).alias(f"best_{metric}"))


def register_run(runs: DataFrame, path: str) -> None:
    """Append run parameters and metrics to the experiment table."""
    runs.write.mode("append").parquet(path)
