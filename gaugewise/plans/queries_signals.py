"""Registered queries: features, anomaly signals, models and labelled data."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewise.config import VARIABLES
from gaugewise.operators import features as ft, inject as inj, models, signals as sg
from gaugewise.plans.oracle import R
from gaugewise.plans.registry import judged, query, r6
from gaugewise.session import fresh_path
from gaugewise.sources import fixtures as fx

def station_no():
    return F.expr("cast(substr(station_id, 5) as bigint)")


@query("f1_features", f"""SELECT reading_id, station_id, CAST(hour(r.ts) AS INTEGER) AS hour,
 {R('r.temperature')} AS temperature, {R('t.x - t.prev_x')} AS delta_temperature, {R('rt.mean')} AS mean_temperature,
 {R('rt.std')} AS std_temperature, {R('h.x - h.prev_x')} AS delta_humidity, {R('rp.mean')} AS mean_pressure
 FROM readings r JOIN (SELECT * FROM adj WHERE variable = 'temperature') t USING (reading_id, station_id)
 JOIN (SELECT * FROM adj WHERE variable = 'humidity') h USING (reading_id, station_id)
 JOIN (SELECT * FROM roll WHERE variable = 'temperature') rt USING (reading_id, station_id)
 JOIN (SELECT * FROM roll WHERE variable = 'pressure') rp USING (reading_id, station_id)""")
def f1(spark, sf):
    return ft.features(fx.readings(spark, sf)).select(
        "reading_id", "station_id", "hour", *map(r6, (
            "temperature", "delta_temperature", "mean_temperature", "std_temperature", "delta_humidity",
            "mean_pressure")))


@query("f2_rolling_stats", f"""SELECT reading_id, variable, n, {R('mean')} AS mean, {R('std')} AS std FROM roll""")
def f2(spark, sf):
    return ft.rolling_stats(fx.readings(spark, sf)).select("reading_id", "variable", "n", r6("mean"), r6("std"))


@query("f3_zscore_signal", f"SELECT reading_id, variable, {R('z')} AS z, {R('z_signal')} AS z_signal FROM stat")
def f3(spark, sf):
    return sg.zscore_signal(fx.readings(spark, sf)).select("reading_id", "variable", r6("z"), r6("z_signal"))


@query("f4_quantile_signal", f"""SELECT s.reading_id, s.variable, {R('q_lo')} AS q_lo, {R('q25')} AS q25, {R('q75')} AS q75,
 {R('q_hi')} AS q_hi, {R('q_signal')} AS q_signal FROM stat s JOIN quant q USING (reading_id, variable)""")
def f4(spark, sf):
    return sg.quantile_signal(fx.readings(spark, sf)).select(
        "reading_id", "variable", *map(r6, ("q_lo", "q25", "q75", "q_hi", "q_signal")))


@query("f5_statistical_score", f"SELECT reading_id, {R('statistical')} AS statistical FROM flagged")
def f5(spark, sf):
    return sg.statistical_score(fx.readings(spark, sf)).select("reading_id", r6("statistical"))


@query("f6_isolation_forest", f"""SELECT reading_id, {R('f.score')} AS isolation_forest, truth
 FROM readings LEFT JOIN forest f USING (reading_id)""")
def f6(spark, sf):
    d = models.model_features(fx.readings(spark, sf))
    return models.isolation_forest_score(models.isolation_forest_fit(d), d).select(
        "reading_id", r6("isolation_forest"), "truth")


@query("f7_reconstruction", f"""SELECT reading_id, {R('c.score')} AS autoencoder, 'pca_reconstruction' AS model_source, truth
 FROM readings LEFT JOIN reconstruction c USING (reading_id)""")
def f7(spark, sf):
    d = models.model_features(fx.readings(spark, sf))
    return models.reconstruction_score(models.reconstruction_fit(d), d).select(
        "reading_id", r6("autoencoder"), F.lit("pca_reconstruction").alias("model_source"), "truth")


@query("f8_ensemble", f"""SELECT reading_id, structural OR coalesce(statistical >= 0.5, false) OR coalesce(forest_score >= 0.65, false)
  OR coalesce(code_score >= 0.9, false) AS anomaly, {R("CASE WHEN structural THEN 1e0 ELSE coalesce(list_avg([statistical, forest_score, code_score]), 0e0) END")}
  AS anomaly_score FROM (SELECT f.*, t.score AS forest_score, c.score AS code_score
  FROM flagged f LEFT JOIN forest t USING (reading_id) LEFT JOIN reconstruction c USING (reading_id))""")
def f8(spark, sf):
    """The ensemble of the three detectors, each with the scores it really gives."""
    rows = fx.readings(spark, sf)
    scored = sg.statistical_score(rows).join(models.model_scores(rows), "reading_id", "left")
    return sg.ensemble(scored).select("reading_id", "anomaly", r6("anomaly_score"))


def _forest(rows):
    """A scorer as the adapter takes it: features in, (reading_id, score) out."""
    d = models.model_features(rows.withColumn("ts", F.timestamp_micros("t")))
    return models.isolation_forest_score(models.isolation_forest_fit(d), d).select(
        "reading_id", F.col("isolation_forest").alias("score"))


@query("f9_adapter", f"""SELECT reading_id, coalesce(f.score >= 0.65, false) AS anomaly, {R('f.score')} AS anomaly_score,
 'isolation_forest' AS model_source FROM readings LEFT JOIN forest f USING (reading_id)""")
def f9(spark, sf):
    return sg.adapt(fx.readings(spark, sf), _forest, "isolation_forest", 0.65).select(
        "reading_id", "anomaly", r6("anomaly_score"), "model_source")


@query("f10_evaluate", f"""SELECT kind, tp, fp, fn, tn, {R('tp / nullif(CAST(tp + fp AS DOUBLE), 0)')} AS "precision",
  {R('tp / nullif(CAST(tp + fn AS DOUBLE), 0)')} AS recall, {R('2e0 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM (
 SELECT kind, count(*) FILTER (WHERE anomaly AND truth IS NOT NULL) AS tp,
  count(*) FILTER (WHERE anomaly AND truth IS NULL) AS fp, count(*) FILTER (WHERE NOT anomaly AND truth IS NOT NULL) AS fn,
  count(*) FILTER (WHERE NOT anomaly AND truth IS NULL) AS tn
 FROM (SELECT 'all' AS kind, anomaly, truth FROM flagged JOIN readings USING (reading_id)
  UNION ALL SELECT truth, anomaly, truth FROM flagged JOIN readings USING (reading_id) WHERE truth IS NOT NULL)
 GROUP BY kind)""")
def f10(spark, sf):
    return sg.evaluate(judged(spark, sf)).select(
        "kind", "tp", "fp", "fn", "tn", *map(r6, ("precision", "recall", "f1")))


@query("f10_roc_auc", f"""SELECT CAST(sum(CASE WHEN pos THEN 1 ELSE 0 END) AS BIGINT) AS positives,
 CAST(sum(CASE WHEN pos THEN 0 ELSE 1 END) AS BIGINT) AS negatives, {R('''(sum(CASE WHEN pos THEN mid END) - sum(CASE WHEN pos THEN 1 ELSE 0 END)
  * (sum(CASE WHEN pos THEN 1 ELSE 0 END) + 1) / 2e0) / (CAST(sum(CASE WHEN pos THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN pos THEN 0 ELSE 1 END))''')} AS auc
 FROM (SELECT pos, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2e0 AS mid
  FROM (SELECT truth IS NOT NULL AS pos, round(anomaly_score + 3e-10, 9) AS g
   FROM flagged JOIN readings USING (reading_id)))""")
def f10b(spark, sf):
    # Ties of the two engines: scores that differ in the last bits only are one score here.
    scores = judged(spark, sf).withColumn("anomaly_score", F.round(F.col("anomaly_score") + 3e-10, 9))
    return sg.roc_auc(scores, "anomaly_score").select("positives", "negatives", r6("auc"))


@query("f11_histogram", """SELECT variable, CAST(least(greatest(floor((x - lo) / width), 0), 19) AS INTEGER) AS bin,
 count(*) AS n FROM (SELECT variable, x, CASE variable WHEN 'temperature' THEN -90e0 WHEN 'pressure' THEN 850e0 ELSE 0e0 END
  AS lo, CASE variable WHEN 'temperature' THEN 7.5e0 WHEN 'pressure' THEN 12e0 ELSE 5e0 END AS width FROM obs
  WHERE x IS NOT NULL) GROUP BY 1, 2""")
def f11(spark, sf):
    return ft.explore(fx.readings(spark, sf))


@query("f11_correlations", f"""SELECT 'temperature' AS a, 'pressure' AS b, count(temperature) AS n,
  {R('corr(temperature, pressure)')} AS corr FROM readings
 UNION ALL SELECT 'temperature', 'humidity', count(temperature), {R('corr(temperature, humidity)')} FROM readings
 UNION ALL SELECT 'pressure', 'humidity', count(*), {R('corr(pressure, humidity)')} FROM readings""")
def f11b(spark, sf):
    return ft.correlations(fx.readings(spark, sf)).select("a", "b", "n", r6("corr"))


def _inject(name: str, kind: str, sql: str, every: int = 100, variable: str = "temperature") -> None:
    @query(name, sql)
    def run(spark, sf):
        out = inj.inject(fx.readings(spark, sf), kind, every, 3, F.col("seq"), station_no())
        return out.select("reading_id", r6(variable), r6("original_value"), "injected", "fault_type")


def _point(kind: str, hit: str, value: str, source: str = "readings", variable: str = "temperature") -> str:
    return (f"SELECT reading_id, {R(f'CASE WHEN {hit} THEN {value} ELSE {variable} END')} AS {variable}, "
            f"{R(variable)} AS original_value, {hit} AS injected, CASE WHEN {hit} THEN '{kind}' END AS fault_type "
            f"FROM {source}")


_HIT = "((seq * 7919 + 3) % 100 = 0)"
_STATION = "((user_id * 7919 + 3) % 10 = 0)"
_ONSET = ("(SELECT *, min(t) OVER (PARTITION BY station_id) + (max(t) OVER (PARTITION BY station_id) "
          "- min(t) OVER (PARTITION BY station_id)) // 2 AS onset FROM readings)")
_AFTER = f"({_STATION} AND t >= onset)"


def _episode(rows: int, value: str, kind: str) -> str:
    inside = f"coalesce(n - s < {rows}, false)"
    return (f"SELECT reading_id, {R(f'CASE WHEN {inside} THEN {value} ELSE temperature END')} AS temperature, "
            f"{R('temperature')} AS original_value, {inside} AS injected, CASE WHEN {inside} THEN '{kind}' END AS fault_type "
            f"FROM (SELECT a.*, b.temperature AS held FROM (SELECT *, max(CASE WHEN {_HIT} THEN n END) OVER "
            f"(PARTITION BY station_id ORDER BY n) AS s FROM (SELECT *, row_number() OVER (PARTITION BY station_id "
            f"ORDER BY t, reading_id) AS n FROM readings)) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY "
            f"station_id ORDER BY t, reading_id) AS m FROM readings) b ON b.station_id = a.station_id AND b.m = a.s)")


_inject("d1_temperature_spike", "temperature_spike", _point("temperature_spike", _HIT, "temperature + 30e0"))
_inject("d2_temperature_drift", "temperature_drift", _point(
    "temperature_drift", _AFTER, "temperature + 0.5e0 * ((t - onset) / 86400000000e0)", _ONSET), 10)
_inject("d3_frozen_sensor", "frozen_sensor", _episode(10, "held", "frozen_sensor"))
_inject("d4_dropout", "dropout", _episode(5, "NULL", "dropout"))
_inject("d5_abrupt_jump", "abrupt_jump", _point("abrupt_jump", _AFTER, "temperature + 8e0", _ONSET), 10)
_inject("d6_bias", "bias", _point("bias", _STATION, "temperature + 4e0"), 10)
_inject("d7_noise", "noise", _point(
    "noise", _HIT, "temperature + 6e0 * (((seq * 104729 + 3) % 10001) / 5000e0 - 1)"))
_inject("d8_inconsistency", "multivariate_inconsistency", _point(
    "multivariate_inconsistency", _HIT, "160e0 - humidity", variable="humidity"), variable="humidity")


@query("d9_benchmark_set", f"""SELECT reading_id, {R('temperature')} AS temperature, false AS injected,
  CAST(NULL AS VARCHAR) AS fault_type FROM readings
 UNION ALL SELECT reading_id, {R('temperature + 30e0')}, true, 'temperature_spike' FROM readings WHERE {_HIT}
 UNION ALL SELECT reading_id, {R('temperature + 4e0')}, true, 'bias' FROM readings WHERE {_STATION}""")
def d9(spark, sf):
    r = fx.readings(spark, sf)
    made = [inj.inject(r, "temperature_spike", 100, 3, F.col("seq"), station_no()),
            inj.inject(r, "bias", 10, 3, F.col("seq"), station_no())]
    return inj.benchmark_set(r, made).select("reading_id", r6("temperature"), "injected", "fault_type")


_SPLIT = """SELECT *, CASE WHEN user_id % 10 = 0 THEN 'holdout' WHEN ts < TIMESTAMP '2024-01-20' THEN 'train'
 WHEN ts < TIMESTAMP '2024-01-25' THEN 'valid' ELSE 'test' END AS split FROM readings"""


def _split(spark, sf):
    at = lambda text: F.lit(text).cast("timestamp")
    return inj.split(fx.readings(spark, sf), at("2024-01-20"), at("2024-01-25"), station_no() % 10 == 0)


@query("d10_splits", f"SELECT reading_id, station_id, split FROM ({_SPLIT})")
def d10(spark, sf):
    return _split(spark, sf).select("reading_id", "station_id", "split")


@query("d10_station_leaks", f"""SELECT DISTINCT station_id FROM ({_SPLIT}) WHERE split = 'train' AND station_id IN
 (SELECT station_id FROM ({_SPLIT}) WHERE split = 'test')""")
def d10b(spark, sf):
    return inj.leaks(_split(spark, sf), "station_id", "train", "test")


@query("d11_best_run", f"""SELECT experiment, arg_max(run_id, (f1, -run_no)) AS best_run, {R('max(f1)')} AS best_f1 FROM (
 SELECT 'threshold' AS experiment, run_no, 'run-' || run_no AS run_id, 2e0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM (
  SELECT run_no, count(*) FILTER (WHERE hit AND truth IS NOT NULL) AS tp, count(*) FILTER (WHERE hit AND truth IS NULL) AS fp,
   count(*) FILTER (WHERE NOT hit AND truth IS NOT NULL) AS fn
  FROM (SELECT run_no, truth, anomaly_score >= run_no / 10e0 AS hit FROM flagged JOIN readings USING (reading_id)
   JOIN (SELECT unnest([3, 4, 5, 6, 7, 8, 9]) AS run_no) g ON true) GROUP BY run_no)) GROUP BY experiment""")
def d11(spark, sf):
    base = judged(spark, sf).withColumn("run_no", F.explode(F.array(*[F.lit(i) for i in range(3, 10)])))
    hit, true = F.col("anomaly_score") >= F.col("run_no") / 10.0, F.col("truth").isNotNull()
    runs = sg.with_rates(base.groupBy("run_no").agg(*sg.confusion(base, hit, true))).select(
        F.lit("threshold").alias("experiment"), "run_no",
        F.concat(F.lit("run-"), F.col("run_no").cast("string")).alias("run_id"), "precision", "recall", "f1")
    path = fresh_path(spark, "runs")
    inj.register_run(runs, path)
    return inj.best_run(spark.read.parquet(path), "f1").select("experiment", "best_run", r6("best_f1"))
