"""Fault archetypes per variable and the router that names a fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewise.config import DEFAULT, US_PER_SECOND, VARIABLES, Config
from gaugewise.functions.columns import safe_div, usable
from gaugewise.operators.features import TAU, adjacent, centred, per_variable
from gaugewise.operators.quality import day_chunk, median_cadence, out_of_bounds, with_gap
from gaugewise.operators.timeline import lookup, rolling_sums, running, with_adjacent

ARCHETYPES = ("dropout", "frozen", "spike", "jump", "drift", "noise", "bias", "inconsistent")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def spike(v: str, cfg: Config) -> Column:
    """A change of at least ``station_scale`` that the next value takes back."""
    step = F.col(v) - F.col(f"prev_{v}")
    back = F.abs(F.col(f"next_{v}") - F.col(f"prev_{v}"))
    return _true((F.abs(step) >= cfg.station_scale[v]) & (back <= cfg.revert_tol * F.abs(step)))


def jump(v: str, cfg: Config) -> Column:
    """Block means before and from this reading differ by ``jump_z`` stds, and this value has moved."""
    full = (F.col(f"pre_n_{v}") == cfg.jump_rows) & (F.col(f"post_n_{v}") == cfg.jump_rows)
    step = F.col(f"post_mean_{v}") - F.col(f"pre_mean_{v}")
    std = F.col(f"pre_std_{v}")
    moved = F.abs(F.col(v) - F.col(f"pre_mean_{v}")) >= F.abs(step) / 2
    return _true(full & (std > cfg.std_floor) & (F.abs(step) > cfg.jump_z * std) & moved & ~spike(v, cfg))


def with_cadence(df: DataFrame, cfg: Config = DEFAULT, source: DataFrame | None = None) -> DataFrame:
    """Attach each station's median reporting gap, taken over ``source`` (all readings). A source that
    already carries ``prev_t`` needs no ordering."""
    rows = df if source is None else source
    if "prev_t" in rows.columns:
        gaps = rows.select("station_id", F.floor((F.col("t") - F.col("prev_t")) / US_PER_SECOND).alias("gap_s"))
    else:
        gaps = with_gap(rows.select("reading_id", "station_id", "t"), cfg)
    return lookup(df, median_cadence(gaps), ["station_id"], cfg.salts)


def impossible_run(v: str, cfg: Config) -> Column:
    """A value out of bounds next to another reading without a usable value: a sentinel where values are missing."""
    return out_of_bounds(v, cfg) & _true((F.col("prev_t").isNotNull() & F.col(f"prev_{v}").isNull()) | (
        F.col("next_t").isNotNull() & F.col(f"next_{v}").isNull()))


def dropout(v: str, cfg: Config) -> Column:
    gap = F.floor((F.col("t") - F.col("prev_t")) / 1_000_000)
    return F.col(v).isNull() | impossible_run(v, cfg) | _true(gap > cfg.dropout_factor * F.col("cadence_s"))


def frozen_runs(df: DataFrame, cfg: Config = DEFAULT, tied_only: bool = False) -> DataFrame:
    """Length of the run of equal consecutive values around each reading and variable.

    Run numbers come from a chunked running count of changes. Only values equal to a neighbour in time
    can be in a run of two or more, so just those are grouped. A run's pieces are counted per chunk
    first, and the join back is on (station, variable, chunk, run), so an endless run never meets in one
    task. A run of missing or unusable values has length 0. ``tied_only`` leaves out runs of one.
    """
    own = {v: usable(v, cfg) for v in VARIABLES}
    order, day = ["t", "reading_id"], day_chunk(cfg)
    near = [f"{p}_{v}" for p in ("prev", "next") for v in VARIABLES]
    base = df if {*near, "prev_t"} <= set(df.columns) else with_adjacent(
        df, ["station_id"], order, 1, day, lambda w: {
            "prev_t": F.lag("t").over(w), **{f"prev_{v}": F.lag(F.expr(x)).over(w) for v, x in own.items()},
            **{f"next_{v}": F.lead(F.expr(x)).over(w) for v, x in own.items()}})
    base = base.select("reading_id", "station_id", "t", "prev_t", *[F.expr(x).alias(v) for v, x in own.items()], *near)
    changes = {f"_run_{v}": ("sum", F.expr(
        f"int(prev_t is null or not ({v} <=> prev_{v}))"), True) for v in VARIABLES}
    rows = per_variable(running(base, ["station_id"], order, day, changes).withColumn("_day", day), {
        v: {"x": F.col(v), "_run": F.col(f"_run_{v}"),
            "_tied": _true((F.col(v) == F.col(f"prev_{v}")) | (F.col(v) == F.col(f"next_{v}")))}
        for v in VARIABLES}, ["reading_id", "station_id", "_day"])
    key = ["station_id", "variable", "_run"]
    tied = rows.where("_tied")
    pieces = tied.groupBy(*key, "_day").agg(F.count(F.lit(1)).alias("_piece"))
    lengths = pieces.select(*key, "_day", F.sum("_piece").over(Window.partitionBy(*key)).alias("run_length"))
    if tied_only:
        return tied.join(lengths, [*key, "_day"]).drop("_day", "_run", "_tied")
    single = F.when(F.col("x").isNull(), 0).otherwise(F.coalesce("run_length", F.lit(1)))
    return rows.join(lengths, [*key, "_day"], "left").withColumn("run_length", single).drop(
        "_day", "_run", "_tied")


def frozen(length: Column, cfg: Config) -> Column:
    return _true(length >= cfg.frozen_run)


def with_residual_history(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rolling sums of the residual against consensus, and of the recent values, in one exchange.
    Needs ``idw_<v>``."""
    w, day, sums = cfg.hist_window_us, cfg.persist_window_us, {}
    for v in VARIABLES:
        r, x = f"({usable(v, cfg)} - idw_{v})", centred(v, cfg)
        tau = f"if({r} is null, null, {TAU})"
        sums |= {f"rn_{v}": (f"if({r} is null, 0, 1)", w), f"rs_{v}": (r, w), f"rss_{v}": (f"{r} * {r}", w),
                 f"ru_{v}": (tau, w), f"ruu_{v}": (f"{tau} * {TAU}", w), f"rux_{v}": (f"{TAU} * {r}", w),
                 f"dayn_{v}": (f"if({usable(v, cfg)} is null, 0, 1)", day), f"days_{v}": (x, day),
                 f"dayss_{v}": (f"{x} * {x}", day)}
    return rolling_sums(df, ["station_id"], "t", ["t", *VARIABLES, *[f"idw_{v}" for v in VARIABLES]],
                        sums, cfg.bucket_us)


def _std(n: Column, s: Column, ss: Column, cfg: Config) -> Column:
    std = F.sqrt(F.greatest(safe_div(ss - s * safe_div(s, n), n - 1), F.lit(0.0)))
    return F.when(n > 1, F.when(std < cfg.std_floor, 0.0).otherwise(std))


def residual_slope(v: str, cfg: Config) -> Column:
    """Trend of the residual per day; NULL under ``min_hist`` residuals."""
    n, s = F.col(f"rn_{v}"), F.col(f"rs_{v}")
    u, uu, ux = F.col(f"ru_{v}"), F.col(f"ruu_{v}"), F.col(f"rux_{v}")
    spread = uu - u * safe_div(u, n)
    return F.when((n >= cfg.min_hist) & (spread > 1e-6), safe_div(ux - u * safe_div(s, n), spread))


def drift(v: str, cfg: Config) -> Column:
    return _true(F.abs(residual_slope(v, cfg)) > cfg.drift_slope[v])


def bias(v: str, cfg: Config) -> Column:
    """A stable offset: large mean residual, small residual std."""
    n, s, ss = F.col(f"rn_{v}"), F.col(f"rs_{v}"), F.col(f"rss_{v}")
    scale = cfg.station_scale[v]
    return _true((n >= cfg.min_hist) & (F.abs(safe_div(s, n)) >= cfg.bias_min * scale)
                 & (_std(n, s, ss, cfg) <= cfg.bias_std_max * scale))


def noise_level(v: str, cfg: Config) -> Column:
    """Std of the last day over ``std_<v>``, the std of the history window."""
    n, s, ss = F.col(f"dayn_{v}"), F.col(f"days_{v}"), F.col(f"dayss_{v}")
    return F.when((n >= cfg.min_recent) & (F.col(f"n_{v}") >= cfg.min_hist),
                  safe_div(_std(n, s, ss, cfg), F.col(f"std_{v}")))


def noise(v: str, cfg: Config) -> Column:
    return _true(noise_level(v, cfg) > cfg.noise_ratio)


def inconsistent(temporal: Column, cfg: Config) -> Column:
    """The station's sensors contradict each other while the variable alone looks plausible."""
    return _true((F.col("cross_sensor") < cfg.inconsistent_sensor)
                 & (temporal.isNull() | (temporal >= cfg.inconsistent_temporal)))


def classify_fault(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Name the fault by the first matching archetype (columns ``is_<archetype>`` at the focus variable).

    The contract has spike and drift for temperature only; for other variables ``fault_type`` stays
    NULL and ``fault_detail`` keeps variable and archetype.
    """
    first = F.coalesce(*[F.when(F.col(f"is_{a}"), F.lit(a)) for a in ARCHETYPES])
    first = F.when(F.col("decision") == "sensor_fault", first)
    on_temperature = F.col("focus") == "temperature"
    names = (F.when(first == "dropout", "dropout").when(first == "frozen", "frozen_sensor")
             .when((first == "spike") & on_temperature, "temperature_spike")
             .when(first == "jump", "abrupt_jump")
             .when((first == "drift") & on_temperature, "temperature_drift")
             .when(first == "noise", "noise").when(first == "bias", "bias")
             .when(first == "inconsistent", "multivariate_inconsistency"))
    return df.withColumns({"fault_type": names, "fault_detail": F.when(
        first.isNotNull(), F.struct(F.col("focus").alias("variable"), first.alias("archetype")))})


def adjacent_flags(df: DataFrame, kind: str, cfg: Config = DEFAULT) -> DataFrame:
    """Per reading and variable: one of the archetypes that only needs neighbouring rows."""
    rule = {"spike": spike, "jump": jump}[kind]
    return per_variable(adjacent(df, cfg), {v: {f"is_{kind}": rule(v, cfg)} for v in VARIABLES},
                        ["reading_id", "station_id"])


def dropout_flags(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return per_variable(with_cadence(adjacent(df, cfg), cfg),
                        {v: {"is_dropout": dropout(v, cfg)} for v in VARIABLES},
                        ["reading_id", "station_id"])


def frozen_flags(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return frozen_runs(df, cfg).select("reading_id", "station_id", "variable", "run_length",
                                       frozen(F.col("run_length"), cfg).alias("is_frozen"))


def residual_flags(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Drift, bias and noise per reading and variable; needs ``n_<v>``, ``std_<v>`` and ``idw_<v>``."""
    return per_variable(with_residual_history(df, cfg), {v: {
        "slope": residual_slope(v, cfg), "is_drift": drift(v, cfg), "is_bias": bias(v, cfg),
        "noise_level": noise_level(v, cfg), "is_noise": noise(v, cfg)} for v in VARIABLES},
        ["reading_id", "station_id"])
