"""Suggested values, correction records, their review lifecycle and the audit trail.

Raw readings are never rewritten: everything here yields separate rows that point at a reading_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewise.config import DEFAULT, VARIABLES, Config
from gaugewise.functions.columns import mean_of, pick, safe_div
from gaugewise.operators.quality import day_chunk
from gaugewise.operators.timeline import running


def with_interpolation(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``interp_<v>``: linear in time between the nearest trusted values on both sides, else the one
    that exists. Trusted = present in an unflagged reading."""
    order, keys = ["t", "reading_id"], ["station_id"]
    known = {v: F.when(F.col(v).isNotNull() & ~F.col("anomaly"),
                       F.struct("t", "reading_id", F.col(v).alias("x"))) for v in VARIABLES}
    out = running(df, keys, order, day_chunk(cfg),
                  {f"_before_{v}": ("max", known[v], False) for v in VARIABLES})
    out = running(out, keys, order, day_chunk(cfg),
                  {f"_after_{v}": ("min", known[v], False) for v in VARIABLES}, descending=True, source=df)
    for v in VARIABLES:
        a, b = F.col(f"_before_{v}"), F.col(f"_after_{v}")
        share = safe_div((F.col("t") - a["t"]).cast("double"), b["t"] - a["t"])
        line = a["x"] + (b["x"] - a["x"]) * F.coalesce(share, F.lit(0.0))
        out = out.withColumn(f"interp_{v}", F.coalesce(line, a["x"], b["x"]))
    return out.drop(*[f"_{s}_{v}" for s in ("before", "after") for v in VARIABLES])


def suggest(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Mean of interpolation and consensus at the focus variable, clamped to physical bounds; NULL for
    genuine weather and for readings without a decision."""
    inputs = mean_of([pick(F.col("focus"), {v: F.col(f"interp_{v}") for v in VARIABLES}),
                      pick(F.col("focus"), {v: F.col(f"idw_{v}") for v in VARIABLES})])
    lo = pick(F.col("focus"), {v: F.lit(cfg.bounds[v][0]) for v in VARIABLES})
    hi = pick(F.col("focus"), {v: F.lit(cfg.bounds[v][1]) for v in VARIABLES})
    value = F.when(inputs.isNotNull(), F.least(F.greatest(inputs, lo), hi))
    return df.withColumns({
        "suggested_value": F.when(F.col("decision").isin("sensor_fault", "uncertain"), value),
        "suggested_variable": F.when(F.col("decision").isin("sensor_fault", "uncertain"), F.col("focus"))})


def corrections(df: DataFrame) -> DataFrame:
    """Correction rows in the table schema, in their first state."""
    return df.where("suggested_value is not null").select(
        F.concat(F.lit("C-"), "reading_id").alias("id"), "reading_id",
        F.col("x").alias("original_value"), "suggested_value", F.lit("SUGGESTED").alias("status"),
        F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_at"))


#: Steps of the lifecycle: a state is how many of them were made, and each event may make the next one only.
STEPS = (("SUGGESTED",), ("PENDING_REVIEW",), ("ACCEPTED", "REJECTED"))


def _within_chunks(events: DataFrame, chunk_us: int) -> DataFrame:
    """Each event with ``_legal``: whether it is legal in its (reading, time chunk) for each state the chunk may begin in.

    From a state, the next legal event is the first of the next step, then the first of the step after that behind it, and
    so on: running maxima over one order, so a chunk is a function from the state it begins in to the one it ends in."""
    before = Window.partitionBy("reading_id", "_c").orderBy("event_ts", "event_no").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = events.withColumn("_c", F.expr(f"floor(unix_micros(event_ts) / {chunk_us})"))
    kinds = [F.coalesce(F.col("status").isin(*names), F.lit(False)) for names in STEPS]
    legal = []
    for state in range(len(STEPS)):
        made, here = F.lit(True), F.lit(False)
        for step in range(state, len(STEPS)):
            name, own = f"_made_{state}_{step}", kinds[step] & made
            rows = rows.withColumn(name, F.coalesce(F.max(own).over(before), F.lit(False)))
            here, made = here | (own & ~F.col(name)), F.col(name)
        legal.append(here)
    return rows.withColumn("_legal", F.array(*legal, F.lit(False))).drop(*[c for c in rows.columns if c.startswith("_made")])


def _begin(chunks: DataFrame) -> DataFrame:
    """The state ``_begin`` that each chunk of a reading begins in, from each chunk's ``_ends``: the functions are composed
    along the chunks. A state is left once, so where it is left is the first chunk behind that leaves it."""
    before = Window.partitionBy("reading_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    out = chunks.withColumn("_begin", F.lit(0))
    for state in range(len(STEPS)):
        leaves = F.when((F.col("_begin") == state) & (F.col("_ends")[state] > state), F.col("_ends")[state])
        out = out.withColumn("_left", F.first(leaves, True).over(before))
        out = out.withColumn("_begin", F.coalesce("_left", "_begin"))
    return out.drop("_left")


def _ends() -> Column:
    """The state at the end of a chunk for each one it may begin in: as many steps on as it has legal events."""
    return F.array(*[(F.count_if(F.col("_legal")[state]) + state).cast("int") for state in range(len(STEPS))],
                   F.lit(len(STEPS))).alias("_ends")


def legal_steps(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Mark each lifecycle event as legal or not.

    The lifecycle only moves forward: the first SUGGESTED is legal, the first PENDING_REVIEW after it, the first verdict after
    that. It is an automaton, folded within (reading, time chunk) and composed over a reading's chunks, so the events are
    read once and a reading with any share of them spreads over its chunks. An event without reading_id is not legal.
    """
    rows = _within_chunks(events, cfg.lifecycle_us)
    begin = _begin(rows.groupBy("reading_id", "_c").agg(_ends())).select("reading_id", "_c", "_begin")
    out = rows.join(begin, ["reading_id", "_c"], "left")
    legal = F.coalesce(F.element_at("_legal", F.col("_begin") + 1), F.lit(False))
    return out.withColumn("legal", legal).select(*events.columns, "legal")


def correction_status(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Fold the events of each correction: latest valid status, its time and actor, illegal count. Chunks are folded
    into one row before they meet, so no event is joined."""
    event = F.struct("event_ts", "event_no", "status", "actor")
    states = range(len(STEPS) + 1)
    chunks = _within_chunks(events, cfg.lifecycle_us).groupBy("reading_id", "_c").agg(
        _ends(), F.count(F.lit(1)).alias("_n"), F.array(*[F.count_if(F.col("_legal")[s]) for s in states]).alias("_made"),
        F.array(*[F.max(F.when(F.col("_legal")[s], event)) for s in states]).alias("_last"))
    own = lambda c: F.element_at(c, F.col("_begin") + 1)
    known = F.col("reading_id").isNotNull()
    return _begin(chunks).groupBy("reading_id").agg(
        F.max(F.when(known, own("_last"))).alias("_l"), F.sum("_n").alias("n_events"), F.sum(
            F.col("_n") - F.when(known, own("_made")).otherwise(0)).alias("n_illegal")).select(
        "reading_id", F.col("_l.status").alias("status"), F.col("_l.event_ts").alias("reviewed_at"),
        F.col("_l.actor").alias("reviewed_by"), "n_events", "n_illegal")


def corrected_view(readings: DataFrame, suggestions: DataFrame, status: DataFrame) -> DataFrame:
    """Raw columns plus ``corrected_<v>``: the suggestion where it was ACCEPTED, else the raw value."""
    accepted = suggestions.join(status.where("status = 'ACCEPTED'").select("reading_id"),
                                "reading_id", "left_semi")
    joined = readings.join(accepted.select("reading_id", "suggested_variable", "suggested_value"),
                           "reading_id", "left")
    chosen = lambda v: F.when(F.col("suggested_variable") == v, F.col("suggested_value"))
    return joined.withColumns({f"corrected_{v}": F.coalesce(chosen(v), F.col(v)) for v in VARIABLES}).drop(
        "suggested_variable", "suggested_value")


def audit_events(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One audit row per lifecycle event, legal or refused, with actor and time."""
    action = F.when(F.col("legal"), F.lower("status")).otherwise(F.concat(F.lit("refused_"), F.lower("status")))
    return legal_steps(events, cfg).select(
        "actor", action.alias("action"), F.lit("correction").alias("entity_type"),
        F.concat(F.lit("C-"), "reading_id").alias("entity_id"),
        F.concat(F.lit("event "), F.col("event_no").cast("string")).alias("details"),
        F.col("event_ts").alias("timestamp"))


def unaudited(events: DataFrame, audit: DataFrame) -> DataFrame:
    """Lifecycle events without an audit row; empty when the trail is complete."""
    details = F.concat(F.lit("event "), F.col("event_no").cast("string"))
    return events.withColumn("details", details).join(audit.select("details"), "details", "left_anti")


