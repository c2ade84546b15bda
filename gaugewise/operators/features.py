"""Rolling history features of a reading, all from one pass of bucketed running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugewise.config import DEFAULT, US_PER_DAY, VARIABLES, Config
from gaugewise.functions.columns import safe_div, usable
from gaugewise.operators.quality import day_chunk
from gaugewise.operators.timeline import finite, lookup, rolling_sums, with_adjacent

PAIRS = (("temperature", "pressure"), ("temperature", "humidity"), ("pressure", "humidity"))
# Time axis of the trend in days since this instant (2020-01-01), to keep its squares small.
TREND_ORIGIN_US = 1_577_836_800_000_000


TAU = f"((t - {TREND_ORIGIN_US}) / {float(US_PER_DAY)}D)"


def _tau(t: Column) -> Column:
    return (t - TREND_ORIGIN_US) / F.lit(float(US_PER_DAY))


def centred(v: str, cfg: Config) -> str:
    return f"({usable(v, cfg)} - {cfg.centre[v]}D)"


def moment_sums(cfg: Config) -> dict[str, tuple[str, int]]:
    w, out = cfg.hist_window_us, {}
    for v in VARIABLES:
        x = centred(v, cfg)
        out |= {f"n_{v}": (f"if({usable(v, cfg)} is null, 0, 1)", w), f"s_{v}": (x, w), f"ss_{v}": (f"{x} * {x}", w)}
    return out


def trend_sums(cfg: Config) -> dict[str, tuple[str, int]]:
    w, out = cfg.hist_window_us, {}
    for v in VARIABLES:
        tau = f"if({usable(v, cfg)} is null, null, {TAU})"
        out |= {f"u_{v}": (tau, w), f"uu_{v}": (f"{tau} * {TAU}", w), f"ux_{v}": (f"{TAU} * {centred(v, cfg)}", w)}
    return out


def pair_sums(cfg: Config, pairs: tuple[tuple[str, str], ...], width_us: int, tag: str
              ) -> dict[str, tuple[str, int]]:
    out = {}
    for a, b in pairs:
        xa, xb, name = centred(a, cfg), centred(b, cfg), f"{tag}_{a}_{b}"
        terms = {"n": "1", "a": xa, "b": xb, "aa": f"{xa} * {xa}", "bb": f"{xb} * {xb}", "ab": f"{xa} * {xb}"}
        out |= {f"{k}_{name}": (f"if({usable(a, cfg)} is null or {usable(b, cfg)} is null, null, {e})", width_us)
                for k, e in terms.items()}
    return out


def history(df: DataFrame, cfg: Config = DEFAULT, trend: bool = True,
            pairs: tuple[tuple[str, str], ...] = PAIRS, recent: bool = True,
            source: DataFrame | None = None) -> DataFrame:
    """Attach every rolling sum of the preceding ``hist_window`` to its reading in one exchange."""
    sums = moment_sums(cfg)
    if trend:
        sums |= trend_sums(cfg)
    sums |= pair_sums(cfg, pairs, cfg.hist_window_us, "hist")
    if recent:
        sums |= pair_sums(cfg, (("temperature", "humidity"),), cfg.corr_window_us, "recent")
    return rolling_sums(finite(df, list(VARIABLES)), ["station_id"], "t", ["t", *VARIABLES], sums, cfg.bucket_us,
                        source)


def with_moments(df: DataFrame, cfg: Config = DEFAULT, trend: bool = False) -> DataFrame:
    """Turn history sums into ``n_<v>``, ``mean_<v>``, ``std_<v>`` and, with ``trend``, the fitted
    ``slope_<v>`` per day and ``predicted_<v>`` at the reading's own time; NULL under ``min_hist``.

    A std under ``std_floor`` counts as 0. Named columns keep later expressions small.
    """
    first, second, spent = [], [], []
    for v in VARIABLES:
        first += [f"s_{v} / nullif(n_{v}, 0) as _m_{v}", f"if(n_{v} > 1, sqrt(greatest((ss_{v} - s_{v} * s_{v} / "
                  f"nullif(n_{v}, 0)) / nullif(n_{v} - 1, 0), 0D)), null) as _sd_{v}"]
        second += [f"{cfg.centre[v]}D + _m_{v} as mean_{v}", f"if(_sd_{v} < {cfg.std_floor}D, 0D, _sd_{v}) as std_{v}",
                   f"cast(n_{v} as bigint) as n_{v}"]
        if trend:
            first.append(f"if(n_{v} >= {cfg.min_hist}, uu_{v} - u_{v} * u_{v} / nullif(n_{v}, 0), null) as _sp_{v}")
            slope = f"if(_sp_{v} > 1e-6D, (ux_{v} - u_{v} * s_{v} / nullif(n_{v}, 0)) / nullif(_sp_{v}, 0), null)"
            second += [f"{slope} as slope_{v}", f"{cfg.centre[v]}D + _m_{v} + {slope} * ({TAU} - u_{v} / "
                       f"nullif(n_{v}, 0)) as predicted_{v}"]
        spent += [f"{p}_{v}" for p in ("s", "ss", "u", "uu", "ux", "n")]
    keep = [c for c in df.columns if c not in spent]
    return df.selectExpr("*", *first).selectExpr(*keep, *second)


def zscore(v: str, cfg: Config) -> Column:
    """Standardised distance from the history mean (``with_moments`` columns)."""
    return F.when(F.col(f"n_{v}") >= cfg.min_hist, safe_div(F.col(v) - F.col(f"mean_{v}"), F.col(f"std_{v}")))


def trend_residual(v: str) -> Column:
    return F.col(v) - F.col(f"predicted_{v}")


def with_corr(df: DataFrame, pairs: tuple[tuple[str, str], ...], tag: str, cfg: Config) -> DataFrame:
    """Turn pair sums into ``corr_<tag>_<a>_<b>``; NULL under ``min_hist`` rows or for a constant input."""
    first, second, spent = [], [], []
    for a, b in pairs:
        m = f"{tag}_{a}_{b}"
        first += [f"if(n_{m} >= {cfg.min_hist}, {p}_{m} - {x}_{m} * {y}_{m} / nullif(n_{m}, 0), null) as _v{p}_{m}"
                  for p, x, y in (("aa", "a", "a"), ("bb", "b", "b"), ("ab", "a", "b"))]
        second.append(f"if(_vaa_{m} > 1e-9D * n_{m} and _vbb_{m} > 1e-9D * n_{m}, _vab_{m} / "
                      f"nullif(sqrt(_vaa_{m}) * sqrt(_vbb_{m}), 0), null) as corr_{m}")
        spent += [f"{k}_{m}" for k in ("n", "a", "b", "aa", "bb", "ab")]
    keep = [c for c in df.columns if c not in spent]
    return df.selectExpr("*", *first).selectExpr(*keep, *second)


def per_variable(df: DataFrame, build: dict[str, dict[str, Column]], keep: list[str]) -> DataFrame:
    """Wide to long: {variable: {column: expression}} to one row per reading and variable."""
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), *[e.alias(c) for c, e in cols.items()])
                     for v, cols in build.items()])
    return df.select(*keep, F.explode(rows).alias("_v")).select(*keep, "_v.*")


def rolling_stats(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rolling n / mean / std per reading and variable, current reading excluded."""
    wide = with_moments(history(df, cfg, trend=False, pairs=(), recent=False), cfg)
    return per_variable(wide, {v: {"x": F.col(v), **{m: F.col(f"{m}_{v}") for m in ("n", "mean", "std")}}
                               for v in VARIABLES}, ["reading_id", "station_id", "t"])


def trend(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    wide = with_moments(history(df, cfg, pairs=(), recent=False), cfg, trend=True)
    return per_variable(wide, {v: {"x": F.col(v), "slope": F.col(f"slope_{v}"),
                                   "predicted": F.col(f"predicted_{v}"), "residual": trend_residual(v)}
                               for v in VARIABLES},
                        ["reading_id", "station_id", "t"])


def rolling_corr(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rolling correlation of each pair of variables per reading."""
    wide = with_corr(history(df, cfg, trend=False, recent=False), PAIRS, "hist", cfg)
    return wide.select("reading_id", "station_id", *[
        F.col(f"corr_hist_{a}_{b}").alias(f"corr_{a}_{b}") for a, b in PAIRS])


def adjacent(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Neighbouring usable values in time (1 back / ahead) and the row blocks on both sides of a reading."""
    k = cfg.jump_rows

    def exprs(w) -> dict[str, Column]:
        out = {"prev_t": F.lag("t").over(w), "next_t": F.lead("t").over(w)}
        if "wind_speed" in df.columns:
            out["prev_wind_speed"] = F.lag("wind_speed").over(w)
        before, after = w.rowsBetween(-k, -1), w.rowsBetween(0, k - 1)
        for v in VARIABLES:
            x = F.expr(usable(v, cfg))
            out |= {f"prev_{v}": F.lag(x).over(w), f"next_{v}": F.lead(x).over(w),
                    f"pre_n_{v}": F.count(x).over(before), f"pre_mean_{v}": F.avg(x).over(before),
                    f"pre_std_{v}": F.stddev_samp(x).over(before),
                    f"post_n_{v}": F.count(x).over(after), f"post_mean_{v}": F.avg(x).over(after)}
        return out

    return with_adjacent(finite(df, list(VARIABLES)), ["station_id"], ["t", "reading_id"], k, day_chunk(cfg), exprs)


def diurnal(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Mean and std of the usable values per station and hour of day, one column pair per variable."""
    return df.groupBy("station_id", F.hour("ts").alias("hour")).agg(*[
        e.alias(f"{name}_{v}") for v in VARIABLES for x in [F.expr(usable(v, cfg))] for name, e in (
            ("dn", F.count(x)), ("dmean", F.avg(x)), ("dstd", F.stddev_samp(x)))])


def with_diurnal_from(df: DataFrame, readings: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return lookup(finite(df, list(VARIABLES)).withColumn("hour", F.hour("ts")), diurnal(readings, cfg),
                  ["station_id", "hour"], cfg.salts)


def with_diurnal(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return with_diurnal_from(df, df, cfg)


def features(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Feature vector inputs: values, deltas to the previous reading, hour, rolling mean and std."""
    wide = adjacent(with_moments(history(df, cfg, trend=False, pairs=(), recent=False), cfg), cfg)
    return wide.select(
        "reading_id", "station_id", F.hour("ts").alias("hour"), *VARIABLES,
        *[(F.col(v) - F.col(f"prev_{v}")).alias(f"delta_{v}") for v in VARIABLES],
        *[f"{m}_{v}" for v in VARIABLES for m in ("mean", "std")])


def explore(df: DataFrame, bins: int = 20, cfg: Config = DEFAULT) -> DataFrame:
    """Histogram of every variable over its physical bounds (long form)."""
    rows = F.array(*[F.struct(
        F.lit(v).alias("variable"), F.lit(cfg.bounds[v][0]).alias("lo"),
        F.lit((cfg.bounds[v][1] - cfg.bounds[v][0]) / bins).alias("width"), F.col(v).alias("x"))
        for v in VARIABLES])
    long = df.select(F.explode(rows).alias("_v")).select("_v.*").where("x is not null")
    bin_no = F.least(F.greatest(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(0)),
                     F.lit(bins - 1))
    return long.groupBy("variable", bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame) -> DataFrame:
    """Whole-table correlation of each pair from moments (a constant input gives NULL)."""
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                              (F.col(a) - DEFAULT.centre[a]).alias("xa"),
                              (F.col(b) - DEFAULT.centre[b]).alias("xb")) for a, b in PAIRS])
    long = df.select(F.explode(rows).alias("_p")).select("_p.*").where("xa is not null and xb is not null")
    m = long.groupBy("a", "b").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("xa").alias("sa"), F.sum("xb").alias("sb"),
        F.sum(F.col("xa") * F.col("xa")).alias("aa"), F.sum(F.col("xb") * F.col("xb")).alias("bb"),
        F.sum(F.col("xa") * F.col("xb")).alias("ab"))
    va = F.col("aa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("bb") - F.col("sb") * F.col("sb") / F.col("n")
    return m.select("a", "b", F.col("n").cast("long").alias("n"), safe_div(
        F.col("ab") - F.col("sa") * F.col("sb") / F.col("n"), F.sqrt(va) * F.sqrt(vb)).alias("corr"))
