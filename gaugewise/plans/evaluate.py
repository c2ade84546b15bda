"""The whole evaluation of a readings table, in written stages.

Each ordered operator reads its input twice (rows and chunk table), so nesting them would recompute
the plan below again and again. Stages that several operators read are therefore written once, and
chunk tables come from the cheapest frame that has the rows (``source``). What needs a station's own rows
only runs in passes over the stations, so its shuffle files are bounded; a stage is deleted after its last reader.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gaugewise.config import DEFAULT, US_PER_HOUR, VARIABLES, Config
from gaugewise.operators import correction, decision, evidence, faults, features, signals, stations as st
from gaugewise.operators.quality import out_of_bounds
from gaugewise.session import cut, discard, noted


def by_station(frames: list[DataFrame], step: Callable[..., DataFrame], name: str, passes: int) -> DataFrame:
    """A written stage of ``step`` of frames, which looks at rows of one station at a time: every station is in one of the
    passes, and the shuffle files of a pass are gone before the next, so they do not grow with the table."""
    part = F.pmod(F.xxhash64("station_id"), F.lit(passes))
    first, *more = [step(*(df if passes == 1 else df.where(part == i) for df in frames)) for i in range(passes)]
    return cut(first, name, *more)


def passes_for(df: DataFrame, cfg: Config = DEFAULT) -> int:
    """How many passes over a table's stations keep to ``rows_per_pass``."""
    return max(1, math.ceil(df.count() / cfg.rows_per_pass))


def observe(readings: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Everything that depends on the station's own readings, reduced to the columns used later."""
    wide = features.history(signals.with_rolling_quantiles(readings, cfg), cfg, pairs=evidence.TH,
                            source=readings)
    wide = evidence.with_corr_term(features.with_moments(wide, cfg, trend=True), cfg)
    wide = signals.with_statistical(wide, cfg)
    derived = ["statistical", "corr_term"]
    for v in VARIABLES:
        derived += [f"stat_{v}", f"n_{v}", f"std_{v}", evidence.trend_excess(v, cfg).alias(f"trend_excess_{v}")]
    return features.adjacent(wide.select(*readings.columns, *derived), cfg)


def flag(observed: DataFrame, cfg: Config = DEFAULT, scores: DataFrame | None = None) -> DataFrame:
    """Anomaly flag and score. ``scores`` may add model signals per reading_id."""
    out = observed if scores is None else observed.join(scores, "reading_id", "left")
    for name in ("isolation_forest", "autoencoder"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return signals.ensemble(out, cfg).withColumn("focus", evidence.focus_variable(cfg))


def gather(flagged: DataFrame, readings: DataFrame, stations: DataFrame, cfg: Config = DEFAULT,
           edges: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """Evidence per reading, also at its focus variable."""
    base = by_station([flagged, readings], lambda rows, own: features.with_diurnal_from(
        evidence.with_persistence(rows, cfg), own, cfg), "persistence", passes_for(flagged, cfg))
    base = st.with_consensus(base, stations, cfg, source=readings, edges=edges, told=told)
    base = base.withColumns({
        **{f"temporal_{v}": evidence.temporal(v, cfg, F.col(f"trend_excess_{v}")) for v in VARIABLES},
        "cross_sensor": evidence.cross_sensor(cfg)})
    focus = decision.per_focus
    base = decision.at_focus(base, {
        "x": {v: F.col(v) for v in VARIABLES}, "idw": focus("idw"), "n_neighbours": focus("nn"),
        "n_agree": focus("agree"), "temporal": focus("temporal"),
        "cross_station": {v: st.cross_station(v, cfg) for v in VARIABLES},
        "impossible": {v: out_of_bounds(v, cfg) for v in VARIABLES},
        "_prev_x": focus("prev"), "_next_x": focus("next")})
    missing_run = (F.col("x").isNull() | F.col("impossible")) & (
        (F.col("prev_t").isNotNull() & F.col("_prev_x").isNull())
        | (F.col("next_t").isNotNull() & F.col("_next_x").isNull()))
    return base.withColumn("missing_run", missing_run).drop("_prev_x", "_next_x")


def with_prior(gathered: DataFrame, health: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Chronic degradation: the station's last known health (``station_id``, ``t``, ``health_score``) is persistence
    evidence of its own, and the worse of the two counts."""
    out = evidence.health_prior(gathered, health, cfg)
    return out.withColumn("persistence", F.greatest("persistence", 1 - F.col("prior_health") / 100))


def judge(gathered: DataFrame, cfg: Config = DEFAULT, health: DataFrame | None = None) -> DataFrame:
    """Evidence vector, decision, confidence and trust."""
    gathered = gathered if health is None else with_prior(gathered, health, cfg)
    out = decision.with_genuineness(evidence.evidence_vector(gathered, cfg), cfg)
    return decision.with_trust(decision.confidence(decision.decide(out, cfg)))


def diagnose(judged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Fault type, suggestion and explanation.

    Only flagged readings need them, so each ordered operator runs over its few columns of the whole history, in passes
    over the stations, and writes its flagged rows; these alone go into the joins on reading_id.
    """
    ids, passes = ["reading_id", "station_id", "t", "anomaly"], passes_for(judged, cfg)
    flagged = judged.where("anomaly")
    resid = by_station([judged.select(*ids, *VARIABLES, *[f"{p}_{v}" for v in VARIABLES for p in ("idw", "n", "std")])],
                       lambda rows: faults.with_residual_history(rows, cfg).where("anomaly").select("reading_id", *[
                           rule(v, cfg).alias(f"is_{a}_{v}") for v in VARIABLES
                           for a, rule in (("drift", faults.drift), ("bias", faults.bias), ("noise", faults.noise))]),
                       "residuals", passes)
    runs = by_station([judged], lambda rows: faults.frozen_runs(rows, cfg, tied_only=True).where(
        F.col("run_length") >= cfg.frozen_run).select("reading_id", "variable"), "runs", passes)
    runs = runs.groupBy("reading_id").agg(F.collect_set("variable").alias("_frozen"))
    interp = by_station([judged.select(*ids, *VARIABLES)], lambda rows: correction.with_interpolation(rows, cfg).where(
        "anomaly").select("reading_id", *[f"interp_{v}" for v in VARIABLES]), "interpolated", passes)
    out = (faults.with_cadence(flagged, cfg, source=judged).join(resid, "reading_id")
           .join(interp, "reading_id").join(runs, "reading_id", "left"))
    out = decision.at_focus(out, {
        "is_dropout": {v: faults.dropout(v, cfg) for v in VARIABLES},
        "is_spike": {v: faults.spike(v, cfg) for v in VARIABLES},
        "is_jump": {v: faults.jump(v, cfg) for v in VARIABLES},
        "is_inconsistent": {v: faults.inconsistent(F.col(f"temporal_{v}"), cfg) for v in VARIABLES},
        **{f"is_{a}": decision.per_focus(f"is_{a}") for a in ("drift", "bias", "noise")}})
    out = out.withColumn("is_frozen", F.coalesce(F.array_contains("_frozen", F.col("focus")), F.lit(False)))
    out = correction.suggest(faults.classify_fault(out, cfg), cfg)
    return decision.explain(out, cfg)


DIAGNOSIS = ("fault_type", "fault_detail", "suggested_value", "suggested_variable", "explanation")


def fit_config(readings: DataFrame, cfg: Config = DEFAULT, stations: DataFrame | None = None) -> Config:
    """Size chunks to the busiest station-hour and salts to the busiest station's share of all rows; a
    two-column count that combines map-side. With ``stations``, chunks of the neighbour joins also count the readings
    that meet in a tile of stations."""
    hours = readings.groupBy("station_id", F.floor(F.col("t") / US_PER_HOUR).alias("h")).count()
    per = hours.groupBy("station_id").agg(F.max("count").alias("hour"), F.sum("count").alias("n"))
    row = per.agg(F.max("hour").alias("hour"), F.max("n").alias("top"), F.sum("n").alias("all")).first()
    asked = 0
    if stations is not None:
        met = st.tiles(stations, cfg).join(per, "station_id").groupBy("_band", "_col").agg(
            F.sum(F.col("hour") * F.col("_times")).alias("rows"))
        asked = (met.agg(F.max("rows")).first()[0] or 0) + 3 * (row["hour"] or 0)
    parts = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cfg.sized_for(row["hour"] or 0, (row["top"] or 0) / max(row["all"] or 0, 1), parts, asked)


def judged(readings: DataFrame, stations: DataFrame, cfg: Config | None = None,
           scores: DataFrame | None = None, health: DataFrame | None = None, edges: DataFrame | None = None,
           told: DataFrame | None = None) -> DataFrame:
    """Decisions and trust of every reading; ``health`` adds the sensors' history to the evidence, ``edges`` and ``told``
    give the station graph and the neighbours' readings where they are not to be derived."""
    cfg = fit_config(readings, stations=stations) if cfg is None else cfg
    flagged = by_station([readings], lambda rows: flag(observe(rows, cfg), cfg, scores), "observed",
                         passes_for(readings, cfg))
    gathered = gather(flagged, readings, stations, cfg, edges, told)
    discard(flagged)  # gathered reads stages written from it
    return judge(gathered, cfg, health)


def judged_stage(readings: DataFrame, stations: DataFrame, cfg: Config | None = None, scores: DataFrame | None = None,
                 health: DataFrame | None = None, edges: DataFrame | None = None, told: DataFrame | None = None
                 ) -> DataFrame:
    """``judged`` as a written stage; the stages behind it are deleted."""
    with noted() as spent:
        found = judged(readings, stations, cfg, scores, health, edges, told)
    out = cut(found, "judged")
    discard(*spent)
    return out


def evaluated(readings: DataFrame, stations: DataFrame, cfg: Config | None = None,
              scores: DataFrame | None = None, health: DataFrame | None = None, edges: DataFrame | None = None,
              told: DataFrame | None = None) -> DataFrame:
    """The full evaluation: every reading, with the diagnosis of the flagged ones."""
    cfg = fit_config(readings, stations=stations) if cfg is None else cfg
    return with_diagnosis(judged_stage(readings, stations, cfg, scores, health, edges, told), cfg)


def with_diagnosis(stage: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Attach the diagnosis to a written table of judged readings.

    Only a flagged reading has one, so the others, which are most, are not moved to meet it; those that share the
    reading_id of a flagged reading are."""
    with noted() as spent:
        found = diagnose(stage, cfg).select("reading_id", *DIAGNOSIS)
    found = cut(found, "found")
    discard(*spent)
    shared = cut(stage.groupBy("reading_id").agg(F.min("anomaly").alias("_least"), F.max("anomaly").alias("_most")).where(
        "_least <> _most").select("reading_id"), "shared")
    others = stage.where("not anomaly")
    meets = stage.where("anomaly").unionAll(others.join(shared, "reading_id", "left_semi").select(*stage.columns))
    out = meets.join(found, "reading_id", "left")
    none = {c: F.lit(None).cast(found.schema[c].dataType) for c in DIAGNOSIS}
    return out.unionByName(others.join(shared, "reading_id", "left_anti").withColumns(none))
