"""Small column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from gaugewise.config import Config


def micros(ts: Column) -> Column:
    """Event time as epoch microseconds, the order key of every time frame."""
    return F.unix_micros(ts)


def usable(v: str, cfg: Config) -> str:
    """SQL text of a value that other readings may rely on: present, finite and within its physical bounds, else NULL.
    Every history and neighbour sum takes its values through this, so that a sentinel or NaN stays with its own reading."""
    lo, hi = cfg.bounds[v]
    return f"if({v} between {lo}D and {hi}D, {v}, null)"


def clip01(x: Column) -> Column:
    """Clip to [0, 1], keeping NULL (least/greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def safe_div(num: Column, den: Column) -> Column:
    """Division that is NULL for a zero or NULL denominator."""
    return F.try_divide(num, den)


def mean_of(cols: Iterable[Column]) -> Column:
    """Mean of the non-NULL inputs; NULL when all are NULL."""
    cols = list(cols)
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return safe_div(total, n.cast("double"))


def pick(variable: Column, values: dict[str, Column]) -> Column:
    """Value of the named variable: {'temperature': col, …} indexed by a column."""
    return F.coalesce(*[F.when(variable == v, c) for v, c in values.items()])


def round_half_up(x: Column) -> Column:
    """Whole number, halves up; the offset keeps a half from falling either way on the last bit."""
    return F.floor(x + 0.5 + 1e-7)
