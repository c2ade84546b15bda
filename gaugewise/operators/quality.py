"""Contract validation, data-quality audits and reshaping of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewise.config import (
    DECISIONS, DEFAULT, FAULT_TYPES, US_PER_DAY, US_PER_SECOND, VARIABLES, Config)
from gaugewise.functions.columns import micros, safe_div
from gaugewise.operators.timeline import lookup, ranged, running, with_adjacent
from gaugewise.schemas import WEATHER_READING

REQUIRED = ("station_id", "ts", "temperature", "pressure", "humidity")


def check_required(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Add the list of missing required fields and whether the row is complete."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return df.withColumn("missing_fields", missing).withColumn("complete", F.size("missing_fields") == 0)


def normalise_ts(df: DataFrame, text: str = "timestamp") -> DataFrame:
    """Parse ISO-8601 text to a UTC instant; zone-less text is UTC, garbage becomes NULL."""
    return df.withColumn("ts", F.try_to_timestamp(F.col(text))).withColumn("t", micros(F.col("ts")))


def check_humidity(df: DataFrame) -> DataFrame:
    return df.withColumn("humidity_ok", F.col("humidity").between(0.0, 100.0))


def check_scores(df: DataFrame, unit: list[str], trust: list[str]) -> DataFrame:
    """Add ``scores_ok``: unit columns in [0, 1], trust columns in 0..100, NULL not accepted."""
    checks = [F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False)) for c in unit]
    checks += [F.coalesce(F.col(c).between(0, 100), F.lit(False)) for c in trust]
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return df.withColumn("scores_ok", ok)


def check_enums(df: DataFrame, decision: str = "decision", fault: str = "fault_type") -> DataFrame:
    return df.withColumns({
        "decision_ok": F.coalesce(F.col(decision).isin(*DECISIONS), F.lit(False)),
        "fault_ok": F.col(fault).isNull() | F.col(fault).isin(*FAULT_TYPES)})


def parse_payload(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Decode a JSON payload; ``corrupt`` holds the text of a row that breaks the contract types."""
    schema = f"{WEATHER_READING}, corrupt string"
    return df.withColumn("decoded", F.from_json(
        payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))


def split_malformed(df: DataFrame, payload: str = "raw_payload") -> tuple[DataFrame, DataFrame]:
    """Split into (good, quarantined): not JSON, or a field of the wrong type."""
    parsed = parse_payload(df, payload)
    bad = F.col("decoded").isNull() | F.col("decoded.corrupt").isNotNull()
    return parsed.where(~bad), parsed.where(bad)


def out_of_bounds(variable: str, cfg: Config = DEFAULT) -> Column:
    lo, hi = cfg.bounds[variable]
    return F.coalesce(~F.col(variable).between(lo, hi), F.lit(False))


def flag_validity(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Set ``quality_flag``: first of ``missing:<v>`` / ``bounds:<v>``, else ``ok``."""
    flags = [F.when(F.col(v).isNull(), F.lit(f"missing:{v}")) for v in VARIABLES]
    flags += [F.when(out_of_bounds(v, cfg), F.lit(f"bounds:{v}")) for v in VARIABLES]
    return df.withColumn("quality_flag", F.coalesce(*flags, F.lit("ok")))


def orphan_readings(df: DataFrame, stations: DataFrame) -> DataFrame:
    return df.join(stations.select("station_id"), "station_id", "left_anti")


def enrich(df: DataFrame, stations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Attach station metadata; unknown stations keep NULL metadata."""
    return lookup(df, stations, ["station_id"], cfg.salts)


def to_long(df: DataFrame, keep: tuple[str, ...] = ("reading_id", "station_id", "ts", "t")) -> DataFrame:
    """One row per reading and variable: the sensor-level grain."""
    return df.unpivot(list(keep), list(VARIABLES), "variable", "x")


def missingness(df: DataFrame) -> DataFrame:
    """Null count and rate per station and variable."""
    counts = df.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(v).isNull()).alias(v) for v in VARIABLES])
    return counts.unpivot(["station_id", "n"], list(VARIABLES), "variable", "n_missing").withColumn(
        "missing_rate", F.col("n_missing") / F.col("n"))


def duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy("station_id", "ts").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def dedupe(df: DataFrame) -> DataFrame:
    """Keep the smallest reading_id per (station, ts). A minimum combines map-side, so a key with
    very many copies never gathers in one task as it would under a window. Rows that lack a part of the
    key may be anything and all stay."""
    keys = ["station_id", "ts"]
    known = F.col("station_id").isNotNull() & F.col("ts").isNotNull()
    rest = [c for c in df.columns if c not in (*keys, "reading_id")]
    kept = df.where(known).groupBy(*keys).agg(F.min(F.struct("reading_id", *rest)).alias("_first"))
    return kept.select(*keys, "_first.*").select(*df.columns).unionAll(df.where(~known))


def day_chunk(cfg: Config) -> Column:
    return F.floor(F.col("t") / F.lit(cfg.chunk_us)).cast("long")


def with_gap(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``gap_s``: whole seconds since the station's previous reading."""
    return with_adjacent(df, ["station_id"], ["t", "reading_id"], 1, day_chunk(cfg), lambda w: {
        "gap_s": F.floor((F.col("t") - F.lag("t").over(w)) / US_PER_SECOND)})


def median_cadence(gaps: DataFrame) -> DataFrame:
    """Exact median gap per station from its gap frequencies, which are counted before they meet."""
    freq = gaps.where("gap_s is not null").groupBy("station_id", "gap_s").agg(
        F.count(F.lit(1)).alias("_f"))
    return freq.groupBy("station_id").agg(
        F.percentile(F.col("gap_s").cast("double"), 0.5, F.col("_f")).alias("cadence_s"))


def timestamp_audit(df: DataFrame, cfg: Config = DEFAULT, ingest: str = "seq") -> DataFrame:
    """Per station: repeated timestamps, out-of-order arrivals, gaps beyond factor x median cadence.

    ``ingest`` is any column that orders arrivals (a sequence number, epoch microseconds): its order is cut into evenly filled
    ranges, so neither its scale nor a busy station matters. Rows without a station are one group of their own."""
    nobody = F.lit("\u0000")
    df = df.withColumn("station_id", F.coalesce("station_id", nobody))
    gaps = with_gap(df, cfg)
    cadence = median_cadence(gaps)
    gap_counts = lookup(gaps, cadence, ["station_id"], cfg.salts).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("cadence_s").alias("cadence_s"),
        F.count_if(F.col("gap_s") > cfg.dropout_factor * F.col("cadence_s")).alias("n_gaps"))
    repeated = duplicates(df).groupBy("station_id").agg(
        F.sum(F.col("copies") - 1).alias("n_repeated"))
    arrivals = ranged(df.select("station_id", "reading_id", "t", ingest), ["station_id", ingest, "reading_id"], "arrivals")
    arrivals = running(arrivals, ["station_id"], [ingest, "reading_id"], F.col("_range"),
                       {"latest": ("max", F.col("t"), False)})
    late = arrivals.groupBy("station_id").agg(
        F.count_if(F.col("t") < F.col("latest")).alias("n_out_of_order"))
    return (gap_counts.join(repeated, "station_id", "left").join(late, "station_id", "left")
            .select(F.nullif("station_id", nobody).alias("station_id"), "n", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
                    F.coalesce("n_out_of_order", F.lit(0)).alias("n_out_of_order"),
                    "cadence_s", "n_gaps"))


def exact_quantiles(df: DataFrame, keys: list[str], x: str, qs: dict[str, float], width: float) -> DataFrame:
    """Exact interpolated quantiles of ``x`` per key, one column per name in ``qs``.

    Distinct values are counted, running counts over chunks of ``width`` give their ranks, and the values at the
    wanted ranks are picked by an aggregate: no task orders a whole key. NULL and NaN do not count.
    """
    counted = df.where(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(*keys, F.col(x).alias("_x")).agg(
        F.count(F.lit(1)).alias("_f"))
    ranked = running(counted, keys, ["_x"], F.floor(F.col("_x") / width), {"_upto": ("sum", F.col("_f"), True)})
    total = counted.groupBy(*keys).agg(F.sum("_f").alias("_n"))
    ranked = lookup(ranked, total, keys, DEFAULT.salts, spread_by="_x")
    here = lambda place: (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_f"))
    picks, out = [], []
    for name, q in qs.items():
        at = F.lit(q) * (F.col("_n") - 1)
        picks += [F.max(F.when(here(F.floor(at)), F.col("_x"))).alias(f"_lo_{name}"),
                  F.max(F.when(here(F.ceil(at)), F.col("_x"))).alias(f"_hi_{name}"),
                  F.first(at - F.floor(at)).alias(f"_w_{name}")]
        out.append((F.col(f"_lo_{name}") + F.col(f"_w_{name}") * (
            F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *out)


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per variable: rows, nulls, distinct values, range and exact quantiles; values are counted per distinct value."""
    long = to_long(df)
    freq = long.groupBy("variable", "x").agg(F.count(F.lit(1)).alias("_f"))
    distinct = F.count("x") if not approximate else F.approx_count_distinct("x")
    stats = freq.groupBy("variable").agg(
        F.sum("_f").alias("n"),
        F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("_f"))), F.lit(0)).alias("n_null"),
        distinct.alias("n_distinct"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    names = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    return stats.join(exact_quantiles(long, ["variable"], "x", names, 0.01), "variable", "left").select(
        *stats.columns, *names)


def select_stations(df: DataFrame, k: int) -> DataFrame:
    """Top-k stations by days with data, then completeness, then id."""
    per_day = df.groupBy("station_id", F.floor(F.col("t") / US_PER_DAY).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(
            F.col("temperature").isNotNull() & F.col("pressure").isNotNull()
            & F.col("humidity").isNotNull()).alias("_full"))
    cover = per_day.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("_n").alias("n"),
        safe_div(F.sum("_full").cast("double"), F.sum("_n")).alias("completeness"))
    return cover.orderBy(F.desc("days"), F.desc("completeness"), "station_id").limit(k)


def raw_diff(before: DataFrame, after: DataFrame, key: str = "reading_id") -> DataFrame:
    """Rows of ``before`` that ``after`` lost or changed; an immutable table yields none."""
    digest = lambda d, name: d.select(key, F.sha2(F.to_json(F.struct(*[
        c for c in before.columns if c != key]), {"ignoreNullFields": "false"}), 256).alias(name))
    both = digest(before, "_was").join(digest(after, "_is"), key, "left")
    return both.where(F.col("_is").isNull() | (F.col("_was") != F.col("_is"))).select(
        key, F.when(F.col("_is").isNull(), "lost").otherwise("changed").alias("change"))


def rows_gone(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset difference: full rows of ``before`` without an equal row in ``after``."""
    return before.exceptAll(after)
