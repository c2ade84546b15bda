"""Statistical anomaly signals, the detector ensemble, the model adapter and detector evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gaugewise.config import DEFAULT, VARIABLES, Config
from gaugewise.functions.columns import clip01, mean_of, safe_div, usable
from gaugewise.functions import worker
from gaugewise.operators.features import history, per_variable, with_moments, zscore
from gaugewise.operators.quality import out_of_bounds
from gaugewise.operators.timeline import finite, running, union_all

# Worker code travels inside the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(worker)

Scorer = Callable[[DataFrame], DataFrame]
_QUANTILES = ("q_lo", "q25", "q75", "q_hi")


def zscore_signal(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    wide = with_moments(history(df, cfg, trend=False, pairs=(), recent=False), cfg)
    return per_variable(wide, {v: {
        "z": zscore(v, cfg), "z_signal": clip01(F.abs(zscore(v, cfg)) / cfg.z_cap)}
        for v in VARIABLES}, ["reading_id", "station_id"])


def with_rolling_quantiles(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Exact quantiles of the usable values of the preceding ``hist_window`` per variable, current time excluded.

    A framed ``percentile`` rebuilds and sorts every frame, rows x frame in all. Here the frames of a (station, chunk of
    ``quantile_us``) are put together from three parts: the chunk's own rows, which enter, the rows one window before,
    which leave, and, where the window is several chunks long, the values of the whole chunks between, counted by Spark
    before they meet. ``worker.QuantileScan`` ranks them all at once, in time that grows with rows x the logarithm
    of distinct values. A busier station gets shorter chunks (``fit_config``); what does not shrink with them is the
    number of distinct values of a window.
    """
    w, c = cfg.hist_window_us, cfg.quantile_us
    if w % c:
        raise ValueError("the history window must be a multiple of the quantile chunk")
    chunk = F.expr(f"(t - pmod(t, {c})) div {c}")
    df = finite(df, list(VARIABLES))
    values = [F.expr(usable(v, cfg)).alias(f"_u_{v}") for v in VARIABLES]
    base = df.select("station_id", "t", chunk.alias("_c"), *values, F.struct(*df.columns).alias("_row"))
    none = F.lit(None).cast(base.schema["_row"].dataType)
    blank = [F.lit(-1).alias("_v"), F.lit(0).cast("long").alias("_n")]
    own = base.select("station_id", "_c", F.lit(2).alias("_kind"), "t", *[f"_u_{v}" for v in VARIABLES], *blank, "_row")
    leaving = base.select("station_id", (F.col("_c") + w // c).alias("_c"), F.lit(1).alias("_kind"), "t",
                          *[f"_u_{v}" for v in VARIABLES], *blank, none.alias("_row"))
    parts = [own, leaving]
    if w > c:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("_v"), F.col(f"_u_{v}").alias("_x"))
                                   for i, v in enumerate(VARIABLES)])).alias("_e")
        runs = base.select("station_id", "_c", each).select("station_id", "_c", "_e.*").where("_x is not null")
        runs = runs.groupBy("station_id", "_c", "_v", "_x").agg(F.count(F.lit(1)).alias("_n"))
        runs = runs.withColumn("_c", F.explode(F.sequence(F.col("_c") + 1, F.col("_c") + (w // c - 1))))
        runs = runs.groupBy("station_id", "_c", "_v", "_x").agg(F.sum("_n").alias("_n"))
        parts.append(runs.select("station_id", "_c", F.lit(0).alias("_kind"), (F.col("_c") * c).alias("t"), *[
            F.when(F.col("_v") == i, F.col("_x")).alias(f"_u_{v}") for i, v in enumerate(VARIABLES)], "_v", "_n",
            none.alias("_row")))
    placed = union_all(parts).repartition("station_id", "_c").sortWithinPartitions("station_id", "_c", "_kind", "t")
    added = [f"{q}_{v}" for v in VARIABLES for q in _QUANTILES]
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in added])
    return placed.mapInArrow(worker.QuantileScan(
        VARIABLES, (cfg.q_lo, 0.25, 0.75, cfg.q_hi), w, c, cfg.min_hist, added), schema)


def quantile_distance(v: str) -> Column:
    """Distance outside [q_lo, q_hi] in interquartile ranges, capped at 1."""
    x, lo, hi = F.col(v), F.col(f"q_lo_{v}"), F.col(f"q_hi_{v}")
    outside = F.when(x.isNotNull() & lo.isNotNull(), F.greatest(lo - x, x - hi, F.lit(0.0)))
    return clip01(safe_div(outside, F.col(f"q75_{v}") - F.col(f"q25_{v}")))


def quantile_signal(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    wide = with_rolling_quantiles(df, cfg)
    return per_variable(wide, {v: {
        **{q: F.col(f"{q}_{v}") for q in _QUANTILES}, "q_signal": quantile_distance(v)}
        for v in VARIABLES}, ["reading_id", "station_id"])


def with_statistical(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """On a frame with moments and quantiles: ``stat_<v>`` per variable and ``statistical``."""
    per = {f"stat_{v}": F.greatest(clip01(F.abs(zscore(v, cfg)) / cfg.z_cap), quantile_distance(v))
           for v in VARIABLES}
    return df.withColumns(per).withColumn("statistical", F.greatest(*[f"stat_{v}" for v in VARIABLES]))


def statistical_score(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    wide = history(with_rolling_quantiles(df, cfg), cfg, trend=False, pairs=(), recent=False, source=df)
    return with_statistical(with_moments(wide, cfg), cfg)


def structural(cfg: Config = DEFAULT) -> Column:
    """A missing or physically impossible value."""
    bad = F.lit(False)
    for v in VARIABLES:
        bad = bad | F.col(v).isNull() | out_of_bounds(v, cfg)
    return bad


def ensemble(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Combine the present signals: any detector flags; score = mean of present signals.

    Needs ``statistical``, ``isolation_forest``, ``autoencoder`` (NULL when absent) and the values. A
    structurally broken reading scores 1.
    """
    names = ("statistical", "isolation_forest", "autoencoder")
    limits = (cfg.flag_stat, cfg.flag_if, cfg.flag_ae)
    flag = structural(cfg)
    for name, limit in zip(names, limits):
        flag = flag | F.coalesce(F.col(name) >= limit, F.lit(False))
    score = F.when(structural(cfg), 1.0).otherwise(
        F.coalesce(mean_of([F.col(n) for n in names]), F.lit(0.0)))
    return df.withColumns({"anomaly": flag, "anomaly_score": score,
                           "signals": F.struct(*[F.col(n) for n in names])})


def adapt(df: DataFrame, scorer: Scorer, source: str, flag_at: float) -> DataFrame:
    """Model boundary: hand the feature columns to any scorer and standardise what it returns.

    ``scorer`` takes a DataFrame with reading_id and features and returns (reading_id, score). It may
    join, use expressions or run ``mapInPandas``; only its output columns are relied upon.
    """
    scored = scorer(df.select("reading_id", "station_id", "t", *VARIABLES))
    missing = {"reading_id", "score"} - set(scored.columns)
    if missing:
        raise ValueError(f"scorer output lacks {sorted(missing)}")
    score = F.col("score").cast("double")
    valid = F.when(score.between(0.0, 1.0), score)
    return scored.select(
        "reading_id", F.coalesce(valid >= flag_at, F.lit(False)).alias("anomaly"),
        valid.alias("anomaly_score"), F.lit(source).alias("model_source"))


def confusion(df: DataFrame, flag: Column, truth: Column) -> list[Column]:
    return [F.count_if(flag & truth).alias("tp"), F.count_if(flag & ~truth).alias("fp"),
            F.count_if(~flag & truth).alias("fn"), F.count_if(~flag & ~truth).alias("tn")]


def with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (df.withColumn("precision", safe_div(tp.cast("double"), tp + fp))
            .withColumn("recall", safe_div(tp.cast("double"), tp + fn))
            .withColumn("f1", safe_div(2.0 * tp, 2 * tp + fp + fn)))


def evaluate(df: DataFrame, truth: str = "truth") -> DataFrame:
    """Precision / recall / F1 over all faults and per fault type (recall side) in one pass."""
    kinds = F.array(F.lit("all"), F.col(truth))
    long = df.select("anomaly", truth, F.explode(F.array_distinct(F.array_compact(kinds))).alias("kind"))
    is_true = F.col(truth).isNotNull()
    return with_rates(long.groupBy("kind").agg(*confusion(long, F.col("anomaly"), is_true)))


def roc_auc(df: DataFrame, score: str, truth: str = "truth", width: float = 1e-4) -> DataFrame:
    """Area under the ROC curve by exact rank sums with ties. Equal scores are counted first; running counts over
    chunks of ``width`` rank them, so no task orders all scores."""
    cells = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_g")).agg(
        F.count_if(F.col(truth).isNotNull()).alias("_p"), F.count_if(F.col(truth).isNull()).alias("_n"))
    part = running(cells, [], ["_g"], F.floor(F.col("_g") / width), {"_below": ("sum", F.col("_n"), True)})
    part = part.withColumn("_below", F.col("_below") - F.col("_n"))
    return part.agg(
        F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"),
        safe_div(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2.0)),
                 F.sum("_p").cast("double") * F.sum("_n")).alias("auc"))
