"""Named interval timers, summarised as a table or on the driver."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Timers:
    """Intervals by name; several threads may time at once."""

    def __init__(self):
        self.pairs: dict[str, list[tuple[float, float]]] = {}
        self._lock = threading.Lock()

    @contextmanager
    def interval(self, name: str) -> Iterator[None]:
        start = time.time()
        try:
            yield
        finally:
            with self._lock:
                self.pairs.setdefault(name, []).append((start, time.time()))

    def merge(self, other: Timers) -> None:
        with self._lock:
            for name, pairs in other.pairs.items():
                self.pairs.setdefault(name, []).extend(pairs)

    def durations(self, name: str) -> list[float]:
        return [b - a for a, b in self.pairs.get(name, [])]

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, t0, t1), for :func:`mosaique.operators.rat.timing_summary`."""
        rows = [(n, a, b) for n, pairs in self.pairs.items() for a, b in pairs]
        return spark.createDataFrame(rows, "name string, t0 double, t1 double")


def report(rows: list) -> str:
    """A text table of timing_summary's rows."""
    lines = [f"{'name':20s} {'total':>10s} {'count':>7s}"]
    lines += [f"{r['name']:20s} {r['total']:10.3f} {r['count']:7d}" for r in sorted(rows, key=lambda r: -r["total"])]
    return "\n".join(lines)
