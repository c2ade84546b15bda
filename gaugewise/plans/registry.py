"""Registry of runnable queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugewise.plans import evaluate
from gaugewise.plans.oracle import build
from gaugewise.session import cut, tune
from gaugewise.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, sql: str | None = None, **tables: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the shared tables of ``plans.oracle`` by name, ``tables`` in place of some."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = build(sql, **tables)
        return fn
    return add


def r6(c: str | Column, alias: str | None = None) -> Column:
    """Report a double at 6 decimals; the small offset keeps exact ties from depending on the last bit."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col + 3e-8, 6).alias(alias or (c if isinstance(c, str) else "value"))


def r4(c: str) -> Column:
    """As ``r6`` at 4 decimals, for regression results."""
    return F.round(F.col(c) + 3e-6, 4).alias(c)


def naive(c: str, alias: str | None = None) -> Column:
    return F.col(c).cast("timestamp_ntz").alias(alias or c)


def stage(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], written: bool = False) -> DataFrame:
    """A derived table, written once per application and table folder and read by all its consumers; ``written``: what
    ``make`` returns is a written stage already."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = make() if written else cut(make(), name)
    return _STAGES[key]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "judged", lambda: evaluate.judged_stage(
        fx.readings(spark, sf_dir), fx.stations(spark, sf_dir)), written=True)


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "evaluated", lambda: evaluate.with_diagnosis(judged(spark, sf_dir)))
