"""Segments emitted as soon as all their pixels have arrived.

A stream of (seg_id, expected, value) rows, ``expected`` being the segment's
pixel count, keeps running sums per segment; the row that completes a segment
emits its statistics and evicts its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mosaique.sources.raster import RasterError

STATE = "n bigint, valid bigint, total bigint, low bigint, high bigint"
OUT = "seg_id bigint, n bigint, valid bigint, total bigint, low bigint, high bigint"


def _add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, valid, total, low, high = state.get if state.exists else (0, 0, 0, None, None)
    expected = 0
    for f in frames:
        v = f["value"].dropna().astype("int64")
        n, valid, total = n + len(f), valid + len(v), total + int(v.sum())
        expected = int(f["expected"].iloc[0])
        if len(v):
            low = int(v.min()) if low is None else min(low, int(v.min()))
            high = int(v.max()) if high is None else max(high, int(v.max()))
    if n >= expected:
        state.remove()
        row = pd.DataFrame([(key[0], n, valid, total, low, high)], columns=["seg_id", "n", "valid", "total", "low", "high"])
        yield row.astype({"low": "Int64", "high": "Int64"})
    else:
        state.update((n, valid, total, low, high))


def check_complete(done: DataFrame, sizes: DataFrame) -> None:
    """An error where the stream has ended and segments of ``sizes`` (seg_id, expected) are not in ``done``."""
    missing = sizes.where("seg_id <> 0 AND expected > 0").join(done, "seg_id", "left_anti")
    n = missing.count()
    if n:
        some = ", ".join(str(r["seg_id"]) for r in missing.select("seg_id").orderBy("seg_id").limit(5).collect())
        raise RasterError(f"{n} segments are incomplete: {some}")


def completed_segments(stream: DataFrame) -> DataFrame:
    """(seg_id, n, valid, total, low, high) of segments as they complete; works on streams only."""
    return stream.groupBy("seg_id").applyInPandasWithState(_add, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
