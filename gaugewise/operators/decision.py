"""Tri-state decision, confidence, trust score, explanation and the final record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugewise.config import DEFAULT, VARIABLES, Config
from gaugewise.functions.columns import pick, round_half_up, safe_div


def genuineness(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the present evidence. Persistence enters as 1 - p: chronic flags speak for a
    degrading sensor. NULL when there is no evidence."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        score = 1 - scores[name] if name == "persistence" else scores[name]
        total = total + F.coalesce(score * w, F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), w).otherwise(0.0)
    return safe_div(total, weight)


def with_genuineness(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``g``. A run of missing values is direct evidence of a dead channel, and a physically impossible value
    of a broken one: g = 0, coverage = 1."""
    g = genuineness({n: F.col(n) for n in cfg.weights}, cfg.weights)
    return df.withColumns({
        "g": F.when(broken(), 0.0).otherwise(g), "coverage": F.when(broken(), 1.0).otherwise(F.col("coverage"))})


def broken() -> Column:
    return F.col("missing_run") | F.col("impossible")


def decide(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``uncertain`` is tested before either verdict, so thin or conflicting evidence is never forced."""
    unsure = (F.col("g").isNull() | (F.col("coverage") < cfg.min_coverage - 1e-9)
              | F.coalesce(F.col("conflict") > cfg.max_conflict, F.lit(False)))
    verdict = (F.when(broken(), "sensor_fault").when(unsure, "uncertain")
               .when(F.col("g") >= cfg.genuine_min, "genuine_weather")
               .when(F.col("g") <= cfg.fault_max, "sensor_fault").otherwise("uncertain"))
    return df.withColumn("decision", F.when(F.col("anomaly"), verdict))


def confidence(df: DataFrame) -> DataFrame:
    """Coverage times distance of g from the undecided middle; 0 without evidence."""
    return df.withColumn("confidence", F.coalesce(
        F.col("coverage") * F.greatest(F.col("g"), 1 - F.col("g")), F.lit(0.0)))


def evidence_support(df: DataFrame) -> DataFrame:
    """The four scores restated as support for the decision that was taken."""
    fault = F.col("decision") == "sensor_fault"
    out = {f"support_{n}": F.when(fault, 1 - F.col(n)).otherwise(F.col(n))
           for n in ("temporal", "cross_sensor", "cross_station")}
    out["support_persistence"] = F.when(fault, F.col("persistence")).otherwise(1 - F.col("persistence"))
    return df.withColumns(out)


def calculate_trust_score(anomaly_score: Column, g: Column, coverage: Column) -> Column:
    """Trust 0..100. The anomaly score only acts through missing genuineness, so a rare but corroborated reading
    keeps a high trust. Genuineness counts as far as evidence covers it: what is absent corroborates nothing."""
    raw = 100 * (1 - anomaly_score * (1 - F.coalesce(g * coverage, F.lit(0.0))))
    return F.least(F.greatest(round_half_up(raw), F.lit(0)), F.lit(100)).cast("int")


def with_trust(df: DataFrame) -> DataFrame:
    return df.withColumn("trust_score", calculate_trust_score(
        F.col("anomaly_score"), F.col("g"), F.col("coverage")))


def trusted(df: DataFrame, min_trust: int) -> DataFrame:
    """Gate for downstream consumers."""
    return df.where(F.col("trust_score") >= min_trust)


def _whole(x: Column) -> Column:
    return round_half_up(x).cast("long").cast("string")


def explain(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Ordered sentences: what was seen, then what supports and what contradicts the reading."""
    focus = F.initcap("focus")
    c = F.col
    sentence = lambda cond, *parts: F.when(cond, F.concat(*parts))
    lines = F.array_compact(F.array(
        sentence(c("x").isNull() & c("missing_run"), focus, F.lit(" is missing in consecutive readings")),
        sentence(c("x").isNull() & ~c("missing_run"), focus, F.lit(" is missing")),
        sentence(c("x").isNotNull(), focus, F.lit(" has anomaly score "), _whole(c("anomaly_score") * 100),
                 F.lit("/100")),
        sentence(c("impossible"), focus, F.lit(" is outside its physical limits")),
        sentence(c("temporal") < cfg.fault_max, focus, F.lit(" changed faster than expected")),
        sentence(c("temporal") >= cfg.genuine_min, focus, F.lit(" changed at a plausible rate")),
        sentence(c("cross_station") < cfg.fault_max, F.lit("Nearby stations disagree: consensus around "),
                 _whole(c("idw")), F.lit(" from "), c("n_neighbours").cast("string"), F.lit(" stations")),
        sentence(c("cross_station") >= cfg.genuine_min, c("n_agree").cast("string"), F.lit(" of "),
                 c("n_neighbours").cast("string"), F.lit(" nearby stations agree")),
        sentence(c("cross_station").isNull(), F.lit("Too few nearby stations to compare")),
        sentence(c("cross_sensor") < cfg.fault_max, F.lit("Other sensors of the station did not support the change")),
        sentence(c("cross_sensor") >= cfg.genuine_min, F.lit("Other sensors of the station are consistent")),
        sentence(c("persistence") >= 0.5, F.lit("The station was flagged repeatedly in the last day")),
        sentence(c("fault_type").isNotNull(), F.lit("Signature matches "), c("fault_type")),
        sentence(c("decision") == "uncertain", F.lit("Evidence is insufficient or conflicting; review needed"))))
    return df.withColumn("explanation", lines)


def final_result(df: DataFrame) -> DataFrame:
    """The contract record of every flagged reading."""
    return df.where("anomaly").select(
        "reading_id", "decision", "fault_type", "trust_score", "confidence", "suggested_value", "explanation")


def at_focus(df: DataFrame, columns: dict[str, dict[str, Column]]) -> DataFrame:
    """Take per-variable columns at each row's focus variable: {name: {variable: column}}."""
    return df.withColumns({n: pick(F.col("focus"), per) for n, per in columns.items()})


def per_focus(prefix: str) -> dict[str, Column]:
    return {v: F.col(f"{prefix}_{v}") for v in VARIABLES}
