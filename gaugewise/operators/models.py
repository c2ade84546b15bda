"""Learned anomaly scores: isolation forest and reconstruction error."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewise.config import DEFAULT, VARIABLES, Config
from gaugewise.functions import worker
from gaugewise.functions.columns import clip01, pick, usable
from gaugewise.operators.quality import exact_quantiles
from gaugewise.operators.timeline import union_all
from gaugewise.session import cut

cloudpickle.register_pickle_by_value(worker)

FEATURES = [*VARIABLES, "hour"]
#: Rows that the trees' samples are drawn from, as a multiple of what the trees need; a bound, whatever the table's size.
THINNED = 4


def model_features(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Usable values and the hour; a reading without one of them gets no model score."""
    return df.withColumns({v: F.expr(usable(v, cfg)) for v in VARIABLES} | {"hour": F.hour("ts").cast("double")})


def _drawn(*parts: Column) -> Column:
    """A whole number below 2**32 from a counter-like text: the same in every run, on every retry and in any SQL."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


@dataclass
class IsolationForest:
    nodes: pd.DataFrame
    features: list[str]
    psi: int

    def score(self) -> Column:
        """Anomaly score in (0, 1] as a column; NULL when a feature is missing."""
        depth = int(np.ceil(np.log2(self.psi)))
        shape = (int(self.nodes["tree"].max()) + 1, 2 << depth)
        arrays = {"feature": np.full(shape, -1), "at": np.zeros(shape), "path": np.zeros(shape)}
        for name, a in arrays.items():
            a[self.nodes["tree"], self.nodes["node"]] = self.nodes[name]
        scorer = worker.ForestScorer(**arrays, depth=depth, scale=worker.mean_path(self.psi))

        @F.pandas_udf("double")
        def forest_score(*columns: pd.Series) -> pd.Series:
            return scorer(columns)

        return F.nanvl(forest_score(*[F.col(f) for f in self.features]), F.lit(None).cast("double"))


def _mean_path(n: Column) -> Column:
    """Expected path length of an unsuccessful search among n points."""
    return F.when(n > 1, 2.0 * (F.ln(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n).otherwise(0.0)


def forest_sample(df: DataFrame, features: list[str], trees: int, psi: int) -> tuple[DataFrame, int]:
    """``psi`` complete rows for each tree (all, if fewer), each in the order of a hash, and that number. Rows are thinned
    once to about ``THINNED`` times what the trees need, so that no more than those are hashed for every tree."""
    ready = df.select("reading_id", *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    n = ready.count()
    psi = min(psi, max(n, 2))
    kept = min(1.0, THINNED * trees * psi / max(n, 1))
    ready = ready.where(_drawn(F.lit("row"), F.col("reading_id")) < F.lit(int(kept * 2**32)))
    share = F.lit(int(min(1.0, 1.3 * psi / max(kept * n, 1.0)) * 2**32))
    placed = ready.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "_o", _drawn(F.lit("tree"), F.col("tree"), F.col("reading_id"))).where(F.col("_o") < share)
    order = Window.partitionBy("tree").orderBy("_o", "reading_id")
    return placed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= psi).drop("_r", "_o"), psi


def isolation_forest_fit(df: DataFrame, features: list[str] = FEATURES, trees: int = 100, psi: int = 256
                         ) -> IsolationForest:
    """Grow all trees level by level (Liu, Ting, Zhou 2008), each from its own hash sample of ``psi`` complete rows.

    A level is one aggregation: a node's ranges, then a feature among those that vary and a place in its range, both drawn
    from (tree, node). What reaches the driver is the forest: at most trees x 2 psi nodes, whatever the table size.
    """
    sample, psi = forest_sample(df, features, trees, psi)
    depth = int(np.ceil(np.log2(psi)))
    rows = cut(sample.withColumn("node", F.lit(1)), "forest-sample")
    levels = []
    for level in range(depth + 1):
        g = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), *[
            e.alias(f"_{name}_{f}") for f in features for name, e in (("lo", F.min(f)), ("hi", F.max(f)))])
        varies = F.filter(F.array(*[F.when(F.col(f"_hi_{f}") > F.col(f"_lo_{f}"), F.lit(i)) for i, f in enumerate(features)]),
                          lambda i: i.isNotNull())
        place = F.get(varies, (_drawn(F.lit("feature"), F.col("tree"), F.col("node")) % F.greatest(
            F.size(varies), F.lit(1))).cast("int"))
        g = g.withColumn("feature", F.coalesce(place, F.lit(-1)) if level < depth else F.lit(-1))
        lo, hi = (pick(F.col("feature"), {i: F.col(f"_{name}_{f}") for i, f in enumerate(features)})
                  for name in ("lo", "hi"))
        share = _drawn(F.lit("at"), F.col("tree"), F.col("node")) / F.lit(2.0**32)
        g = g.select("tree", "node", "feature", F.coalesce(lo + share * (hi - lo), F.lit(0.0)).alias("at"), F.when(
            F.col("feature") < 0, level + _mean_path(F.col("n"))).otherwise(0.0).alias("path"))
        g = cut(g, "forest-level")
        levels.append(g)
        if level < depth:
            x = pick(F.col("feature"), {i: F.col(f) for i, f in enumerate(features)})
            rows = cut(rows.join(g.where("feature >= 0"), ["tree", "node"]).withColumn(
                "node", 2 * F.col("node") + (x > F.col("at")).cast("int")).select(*rows.columns), "forest-rows")
    return IsolationForest(union_all(levels).toPandas(), features, psi)


def isolation_forest_score(model: IsolationForest, df: DataFrame) -> DataFrame:
    return df.withColumn("isolation_forest", model.score())


@dataclass
class Reconstruction:
    """Linear autoencoder: projection onto the leading principal components and back."""

    features: list[str]
    mean: list[float]
    std: list[float]
    components: list[list[float]]
    p99: float = 1.0

    def error(self) -> Column:
        """Squared distance to the component subspace; plain column arithmetic, no UDF."""
        z = [(F.col(f) - m) / s for f, m, s in zip(self.features, self.mean, self.std)]
        total = sum((v * v for v in z[1:]), z[0] * z[0])
        for c in self.components:
            along = sum((v * w for v, w in zip(z[1:], c[1:])), z[0] * c[0])
            total = total - along * along
        return F.greatest(total, F.lit(0.0)) + 0 * total

    def score(self) -> Column:
        return clip01(self.error() / self.p99)


def reconstruction_fit(df: DataFrame, features: list[str] = FEATURES, k: int = 2) -> Reconstruction:
    """The linear autoencoder of ``k`` units: all moments in one aggregation, principal axes of the correlation matrix (as
    wide as the features) on the driver, errors scaled by their exact 99th percentile over the fitted rows."""
    ready = df.select(*features).dropna()
    middle = ready.agg(*[F.avg(f).alias(f) for f in features]).first()
    if middle[0] is None:
        return Reconstruction(features, [0.0] * len(features), [1.0] * len(features), [])
    off = [F.col(f) - F.lit(float(m)) for f, m in zip(features, middle)]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    row = ready.agg(F.count(F.lit(1)), *[F.sum(off[i] * off[j]) for i, j in pairs]).first()
    spread = np.zeros((len(features), len(features)))
    for (i, j), s in zip(pairs, row[1:]):
        spread[i, j] = spread[j, i] = s / max(row[0] - 1, 1)
    std = np.sqrt(np.diag(spread))
    std[std == 0] = 1.0
    _, axes = np.linalg.eigh(spread / np.outer(std, std))
    model = Reconstruction(features, [float(m) for m in middle], [float(s) for s in std], [
        [float(x) for x in axes[:, -1 - i]] for i in range(k)])
    errors = ready.select(F.lit(0).alias("_k"), model.error().alias("_e"))
    model.p99 = max(float(exact_quantiles(errors, ["_k"], "_e", {"p99": 0.99}, 0.01).first()["p99"]), 1e-12)
    return model


def reconstruction_score(model: Reconstruction, df: DataFrame) -> DataFrame:
    return df.withColumn("autoencoder", model.score())


def model_scores(df: DataFrame) -> DataFrame:
    """Both learned signals per reading, fitted on ``df`` itself."""
    ready = model_features(df)
    both = reconstruction_score(reconstruction_fit(ready), isolation_forest_score(
        isolation_forest_fit(ready), ready))
    return both.select("reading_id", "isolation_forest", "autoencoder")
