"""Temporal, cross-sensor and persistence evidence as plausibilities in [0, 1].

NULL means "no evidence" throughout and is never replaced by a neutral number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugewise.config import DEFAULT, US_PER_MINUTE, VARIABLES, Config
from gaugewise.functions.columns import clip01, mean_of, pick, safe_div
from gaugewise.functions.physics import dew_point
from gaugewise.operators.features import (
    adjacent, history, per_variable, trend_residual, with_corr, with_diurnal_from, with_moments)
from gaugewise.operators.quality import day_chunk, out_of_bounds
from gaugewise.operators.timeline import rolling_sums, running


# ---- temporal ---------------------------------------------------------------------------------

def rate(v: str) -> Column:
    minutes = (F.col("t") - F.col("prev_t")) / F.lit(float(US_PER_MINUTE))
    return safe_div(F.col(v) - F.col(f"prev_{v}"), minutes)


def rate_of_change(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Change per minute against the previous reading of the same sensor."""
    return per_variable(adjacent(df, cfg), {v: {
        "gap_us": F.col("t") - F.col("prev_t"), "rate": rate(v)} for v in VARIABLES},
        ["reading_id", "station_id", "t"])


def rate_violation(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Changes faster than the physical limit of their variable."""
    hard = pick(F.col("variable"), {v: F.lit(r) for v, r in cfg.rate_hard.items()})
    return rate_of_change(df, cfg).where(F.abs("rate") > hard)


def rate_excess(v: str, cfg: Config) -> Column:
    recent = (F.col("t") - F.col("prev_t")) <= cfg.max_rate_gap_us
    soft, hard = cfg.rate_soft[v], cfg.rate_hard[v]
    return F.when(recent, clip01((F.abs(rate(v)) - soft) / (hard - soft)))


def deviation_excess(deviation: Column, std: Column, cfg: Config) -> Column:
    return clip01(safe_div(F.abs(deviation), cfg.z_cap * std))


def trend_excess(v: str, cfg: Config) -> Column:
    return deviation_excess(trend_residual(v), F.col(f"std_{v}"), cfg)


def temporal(v: str, cfg: Config, trend: Column | None = None) -> Column:
    """1 - the worst of rate excess and discounted trend / diurnal excess; NULL without a recent rate."""
    trend = trend_excess(v, cfg) if trend is None else trend
    daily = F.when(F.col(f"dn_{v}") >= cfg.min_hist, deviation_excess(
        F.col(v) - F.col(f"dmean_{v}"), F.col(f"dstd_{v}"), cfg))
    excess = rate_excess(v, cfg)
    return F.when(excess.isNotNull(), 1 - F.greatest(
        excess, cfg.rarity_weight * trend, cfg.rarity_weight * daily))


def temporal_evidence(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    wide = with_moments(history(df, cfg, pairs=(), recent=False), cfg, trend=True)
    wide = with_diurnal_from(adjacent(wide, cfg), df, cfg)
    return per_variable(wide, {v: {"rate_excess": rate_excess(v, cfg), "temporal": temporal(v, cfg)}
                               for v in VARIABLES}, ["reading_id", "station_id"])


# ---- cross-sensor -----------------------------------------------------------------------------

def dew_term(cfg: Config) -> Column:
    point = dew_point(F.col("temperature"), F.col("humidity"))
    return F.when(point > cfg.max_dew_point, 0.0).when(point.isNotNull(), 1.0)


def t_rh_term(cfg: Config) -> Column:
    """Humidity must move against a temperature change of at least ``dt_min``."""
    d_t = F.col("temperature") - F.col("prev_temperature")
    d_rh = F.col("humidity") - F.col("prev_humidity")
    against = (-F.signum(d_t) * d_rh) / (cfg.rh_per_degree * F.abs(d_t))
    return (F.when(d_t.isNull() | d_rh.isNull(), F.lit(None).cast("double"))
            .when(F.abs(d_t) < cfg.dt_min, 1.0).otherwise(1 - clip01(1 - against)))


def p_wind_term(cfg: Config) -> Column:
    """A sharp pressure fall should come with rising wind; NULL where no wind is measured."""
    d_p = F.col("pressure") - F.col("prev_pressure")
    d_w = F.col("wind_speed") - F.col("prev_wind_speed")
    return (F.when(d_p.isNull() | d_w.isNull(), F.lit(None).cast("double"))
            .when(d_p > -cfg.dp_min, 1.0)
            .otherwise(clip01(d_w / (cfg.gust_per_hpa * F.abs(d_p)))))


TH = (("temperature", "humidity"),)


def with_corr_term(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``corr_term``: how much the recent T/RH correlation keeps to the usual one."""
    out = with_corr(with_corr(df, TH, "hist", cfg), TH, "recent", cfg)
    usual, recent = (F.col(f"corr_{tag}_temperature_humidity") for tag in ("hist", "recent"))
    return out.withColumn("corr_term", 1 - F.abs(recent - usual) / 2).drop(
        "corr_hist_temperature_humidity", "corr_recent_temperature_humidity")


def cross_sensor(cfg: Config) -> Column:
    """An impossible dew point refutes outright; else the mean of the terms that exist."""
    others = mean_of([t_rh_term(cfg), p_wind_term(cfg), F.col("corr_term")])
    return F.when(dew_term(cfg) == 0.0, 0.0).otherwise(others)


def t_rh_consistency(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return adjacent(df, cfg).select(
        "reading_id", "station_id", dew_point(F.col("temperature"), F.col("humidity")).alias("dew_point"),
        dew_term(cfg).alias("dew_term"), t_rh_term(cfg).alias("t_rh"))


def p_wind_consistency(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return adjacent(df, cfg).select("reading_id", "station_id", p_wind_term(cfg).alias("p_wind"))


def cross_sensor_evidence(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    wide = adjacent(with_corr_term(history(df, cfg, trend=False, pairs=TH), cfg), cfg)
    return wide.select("reading_id", "station_id", dew_term(cfg).alias("dew_term"),
                       t_rh_term(cfg).alias("t_rh"), "corr_term", cross_sensor(cfg).alias("cross_sensor"))


# ---- persistence ------------------------------------------------------------------------------

def with_persistence(df: DataFrame, cfg: Config = DEFAULT, source: DataFrame | None = None) -> DataFrame:
    """Share of the station's readings flagged in the trailing window; NULL without any reading."""
    out = rolling_sums(df, ["station_id"], "t", ["anomaly"], {
        "_pn": ("1", cfg.persist_window_us), "_pf": ("int(anomaly)", cfg.persist_window_us)}, cfg.bucket_us, source)
    return out.withColumn("persistence", safe_div(F.col("_pf"), F.col("_pn"))).drop("_pn", "_pf")


def with_flag_run(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Consecutive flagged readings up to this one, across any number of time chunks."""
    numbered = running(df, ["station_id"], ["t", "reading_id"], day_chunk(cfg),
                       {"_seq": ("sum", F.lit(1), True)})
    out = running(numbered, ["station_id"], ["t", "reading_id"], day_chunk(cfg),
                  {"_calm": ("max", F.when(~F.col("anomaly"), F.col("_seq")), True)})
    return out.withColumn("flag_run", F.col("_seq") - F.coalesce("_calm", F.lit(0))).drop("_seq", "_calm")


def health_prior(df: DataFrame, health: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """As-of join: the station's latest health row at or before each reading.

    ``health``: station_id, t, health_score. Both tables share one timeline per station, so the last
    known score is a running maximum over (time, score).
    """
    rows = df.withColumn("_is_reading", F.lit(1)).unionByName(
        health.select("station_id", "t", "health_score", F.lit(0).alias("_is_reading")), allowMissingColumns=True)
    known = F.when(F.col("_is_reading") == 0, F.struct("t", "health_score"))
    out = running(rows, ["station_id"], ["t", "_is_reading"], day_chunk(cfg), {"_last": ("max", known, True)})
    return out.where("_is_reading = 1").drop("health_score", "_is_reading").withColumn(
        "prior_health", F.col("_last.health_score")).withColumn(
        "health_t", F.col("_last.t")).drop("_last")


# ---- focus and vector -------------------------------------------------------------------------

def focus_variable(cfg: Config) -> Column:
    """The most anomalous variable: structural faults first, then the highest statistical score."""
    ranks = [F.when(F.col(v).isNull() | out_of_bounds(v, cfg), 2.0)
             .otherwise(F.coalesce(F.col(f"stat_{v}"), F.lit(-1.0))) for v in VARIABLES]
    best = F.greatest(*ranks)
    return F.coalesce(*[F.when(r == best, F.lit(v)) for v, r in zip(VARIABLES, ranks)])


def evidence_vector(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``evidence``, ``coverage`` (weight of present evidence) and ``conflict`` (spread of the
    three physical scores) from the four score columns."""
    names = list(cfg.weights)
    cover = sum((F.when(F.col(n).isNotNull(), cfg.weights[n]).otherwise(0.0) for n in names), F.lit(0.0))
    physical = [F.col(n) for n in names if n != "persistence"]
    return df.withColumns({
        "evidence": F.struct(*names), "coverage": cover,
        "conflict": F.greatest(*physical) - F.least(*physical)})
