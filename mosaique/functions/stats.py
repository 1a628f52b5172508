"""Per-segment statistics by name, each an aggregate of one column.

NULL is no-data and never counts. Means and deviations are FLOAT; deviations are
those of the population, from the mean as a FLOAT holds it. ``median`` and
``percentile`` are values of the segment: the smallest whose cumulative count
reaches n * (p / 100); a percentile's p is cut to an integer, and p = 0 gives
the largest value. ``mode`` is the smallest of the most frequent values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = -9999


def _mean(v: str, _: float) -> Column:
    return F.avg(v).cast("float")


def _stddev(v: str, _: float) -> Column:
    off = F.avg(v) - F.avg(v).cast("float").cast("double")
    return F.sqrt(F.var_pop(v) + off * off).cast("float")


def _percentile(v: str, p: float) -> Column:
    p = int(p)
    if p == 0:
        return F.max(v)
    # the fraction is a double of Python's, so that the rank is computed from the same number
    return F.expr(f"percentile_disc({p / 100!r}D) WITHIN GROUP (ORDER BY `{v}`)").cast("bigint")


#: Aggregates by name; each takes the column's name and the statistic's parameter.
STATS: dict[str, Callable[[str, float], Column]] = {
    "min": lambda v, _: F.min(v),
    "max": lambda v, _: F.max(v),
    "mean": _mean,
    "stddev": _stddev,
    "median": lambda v, _: _percentile(v, 50),
    "mode": lambda v, _: F.mode(F.col(v), True),
    "percentile": _percentile,
    "pixcount": lambda v, _: F.count(v),
}

#: Statistics that a segment without valid pixels has.
COUNTS = {"pixcount"}


def stat(name: str, column: str, param: float = 0) -> Column:
    """The aggregate for a statistic; an unknown name is a KeyError."""
    return STATS[name](column, param)


def kind_of(name: str) -> str:
    """The attribute column's type for a statistic."""
    return "float" if name in ("mean", "stddev") else "bigint"
