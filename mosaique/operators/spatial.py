"""User-defined per-segment statistics over points.

A function gets a segment's valid points, a frame with columns x, y and val in
scan order, and a parameter, and returns one value per output column. It is not
called for segments without valid points, whose outputs are the missing value.
Functions are found by name in :data:`REGISTRY`. Those in :data:`BATCHED` also
take many whole segments at once, by sorted positions instead of boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaique.functions.stats import MISSING
from mosaique.operators.neighbours import offsets
from mosaique.sources.raster import RasterError

UserFunc = Callable[[pd.DataFrame, Any], Sequence[float]]

REGISTRY: dict[str, UserFunc] = {}

#: (points of whole segments with their number ``s`` from 0, all sorted by s, y and x; parameter): an array per output column.
BatchFunc = Callable[[pd.DataFrame, Any], Sequence[np.ndarray]]

BATCHED: dict[str, BatchFunc] = {}


def register(name: str) -> Callable[[UserFunc], UserFunc]:
    """Decorator that names a per-segment function."""

    def add(f: UserFunc) -> UserFunc:
        REGISTRY[name] = f
        return f

    return add


def batched(name: str) -> Callable[[BatchFunc], BatchFunc]:
    """Decorator that gives a registered function its form for many segments."""

    def add(f: BatchFunc) -> BatchFunc:
        BATCHED[name] = f
        return f

    return add


def value_array(pts: pd.DataFrame, fill: int) -> np.ndarray:
    """The points' box as a dense array of values; gaps hold ``fill``."""
    y, x = pts["y"].to_numpy(), pts["x"].to_numpy()
    out = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), fill, np.int64)
    out[y - y.min(), x - x.min()] = pts["val"].to_numpy()
    return out


def mask_array(pts: pd.DataFrame) -> np.ndarray:
    """The points' box as a dense array of 1 for points and 0 for gaps."""
    return value_array(pts.assign(val=1), 0)


@register("mean_coord")
def mean_coord(pts: pd.DataFrame, gt: list[float]) -> tuple[float, float]:
    x, y = pts["x"].to_numpy(float), pts["y"].to_numpy(float)
    return (gt[0] + gt[1] * x + gt[2] * y).mean(), (gt[3] + gt[4] * x + gt[5] * y).mean()


@register("num_edge_pixels")
def num_edge_pixels(pts: pd.DataFrame, four_connected: bool) -> tuple[int]:
    inside = np.pad(mask_array(pts), 1)
    whole = inside.copy()
    for dr, dc in offsets(four_connected):
        whole &= np.roll(inside, (-dr, -dc), (0, 1))
    return (int(inside.sum() - whole.sum()),)


@register("variogram")
def variogram(pts: pd.DataFrame, max_dist: int) -> list[float]:
    known = np.pad(mask_array(pts), max_dist).astype(bool)
    value = np.pad(value_array(pts, 0), max_dist)
    total, n = np.zeros(max_dist + 1), np.zeros(max_dist + 1)
    for dy in range(1, max_dist + 1):
        for dx in range(1, max_dist + 1):
            b = int(np.sqrt(dx * dx + dy * dy))
            if b <= max_dist:
                both = known & np.roll(known, (-dy, -dx), (0, 1))
                diff = (value - np.roll(value, (-dy, -dx), (0, 1)))[both]
                total[b] += float((diff * diff).sum())
                n[b] += len(diff)
    return [float(np.sqrt(t / k)) if k else float(MISSING) for t, k in zip(total[1:], n[1:])]


def _places(pts: pd.DataFrame, reach: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Distinct points, a rising number for each and the step of a row; numbers ``reach`` apart stay in their segment."""
    s, y, x = (pts[c].to_numpy(np.int64) for c in ("s", "y", "x"))
    last = np.append((np.diff(s) != 0) | (np.diff(y) != 0) | (np.diff(x) != 0), True)
    if not last.all():
        pts, s, y, x = pts[last], s[last], y[last], x[last]
    first = np.flatnonzero(np.append(True, np.diff(s) != 0))
    low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    top, bottom = y[first], y[np.append(first[1:], len(s)) - 1]
    width = high - low + 1 + 2 * reach
    size = width * (bottom - top + 1 + 2 * reach)
    base = np.cumsum(size) - size
    return pts, base[s] + (y - top[s] + reach) * width[s] + x - low[s] + reach, width[s]


def _found(place: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices in ``place`` or just past, whether it is there) of each number wanted."""
    at = np.searchsorted(place, wanted)
    return at, place[np.minimum(at, len(place) - 1)] == wanted


@batched("mean_coord")
def mean_coords(pts: pd.DataFrame, gt: list[float]) -> list[np.ndarray]:
    s, x, y = pts["s"].to_numpy(), pts["x"].to_numpy(float), pts["y"].to_numpy(float)
    n = np.bincount(s)
    return [np.bincount(s, g[0] + g[1] * x + g[2] * y) / n for g in (gt[:3], gt[3:6])]


@batched("num_edge_pixels")
def nums_edge_pixels(pts: pd.DataFrame, four_connected: bool) -> list[np.ndarray]:
    pts, place, width = _places(pts, 1)
    whole = np.ones(len(place), bool)
    for dr, dc in offsets(four_connected):
        whole &= _found(place, place + dr * width + dc)[1]
    return [np.bincount(pts["s"].to_numpy()[~whole], minlength=pts["s"].iloc[-1] + 1)]


@batched("variogram")
def variograms(pts: pd.DataFrame, max_dist: int) -> list[np.ndarray]:
    pts, place, width = _places(pts, max_dist)
    s, value = pts["s"].to_numpy(), pts["val"].to_numpy()
    total, n = np.zeros((2, max_dist + 1, s[-1] + 1))
    for dy in range(1, max_dist + 1):
        for dx in range(1, max_dist + 1):
            b = int(np.sqrt(dx * dx + dy * dy))
            if b <= max_dist:
                at, known = _found(place, place + dy * width + dx)
                diff = value[at[known]] - value[known]
                total[b] += np.bincount(s[known], diff * diff, s[-1] + 1)
                n[b] += np.bincount(s[known], minlength=s[-1] + 1)
    with np.errstate(invalid="ignore"):
        return [np.where(k > 0, np.sqrt(t / k), MISSING) for t, k in zip(total[1:], n[1:])]


def _whole_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by ``seg_id`` cut anew where segments end; a segment over many frames is put together once."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        ids = pdf["seg_id"].to_numpy()
        at = int(np.searchsorted(ids, ids[-1]))  # where the last segment begins
        if held and (at or held[-1]["seg_id"].iloc[-1] != ids[-1]):
            yield pd.concat([*held, pdf.iloc[:at]], ignore_index=True)
            held = []
        elif at:
            yield pdf.iloc[:at].reset_index(drop=True)
        held.append(pdf.iloc[at:])
    if held:
        yield pd.concat(held, ignore_index=True)


#: The functions that the forms of BATCHED belong to.
_OWN = {name: REGISTRY[name] for name in BATCHED}


def _column(values: Sequence, kind: str):
    """A column of results; None and NaN are null."""
    if isinstance(values, np.ndarray):
        return values
    gone = [v is None or v != v for v in values]
    return pd.array([None if g else v for v, g in zip(values, gone)], dtype="Float64") if kind != "int" else pd.array(
        [None if g else int(v) for v, g in zip(values, gone)], dtype="Int64"
    )


def spatial_stats(
    valued: DataFrame,
    columns: Sequence[tuple[str, str]],
    func: str | UserFunc,
    param: Any = None,
    band: str = "b1",
    missing: float = MISSING,
) -> DataFrame:
    """(seg_id, one column per name and type) of ``valued`` (seg_id, row, col and a band, NULL for no-data)."""
    if not columns:
        raise RasterError("at least one column is needed")
    run = REGISTRY[func] if isinstance(func, str) else func
    # a name stands for its form for many segments unless the function was registered anew
    many = BATCHED.get(func) if isinstance(func, str) and run is _OWN.get(func) else None
    val = F.col(band)
    zero = F.lit(0).cast(valued.schema[band].dataType)
    own = valued.where("seg_id <> 0").select(
        F.col("seg_id").cast("bigint").alias("seg_id"), F.col("col").alias("x"), F.col("row").alias("y"),
        F.coalesce(val, zero).alias("val"), val.isNotNull().alias("known"),
    )

    def results(pts: pd.DataFrame, starts: np.ndarray) -> list:
        if many:
            return list(many(pts.assign(s=np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pts))))), param))
        ends = [*starts[1:].tolist(), len(pts)]
        rows = [run(pts.iloc[a:b].reset_index(drop=True), param) for a, b in zip(starts.tolist(), ends)]
        return [list(c) for c in zip(*rows)]

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_segments(frames):
            every = np.unique(pdf["seg_id"].to_numpy())
            valid = pdf[pdf["known"].to_numpy(bool)]
            ids, starts = np.unique(valid["seg_id"].to_numpy(), return_index=True)
            if len(ids):
                found = results(valid[["x", "y", "val"]].reset_index(drop=True), starts)
                yield pd.DataFrame({"seg_id": ids, **{n: _column(v, t) for (n, t), v in zip(columns, found, strict=True)}})
            if len(every) > len(ids):
                rest = np.setdiff1d(every, ids, assume_unique=True)
                yield pd.DataFrame({"seg_id": rest, **{n: _column([None] * len(rest), t) for n, t in columns}})

    kinds = ", ".join(f"`{n}` {'bigint' if t == 'int' else 'double'}" for n, t in columns)
    # one pass over sorted points, many segments to a call: a call for each segment costs more than its work
    placed = own.repartition("seg_id").sortWithinPartitions("seg_id", "y", "x")
    found = placed.mapInPandas(batch, f"seg_id bigint, {kinds}")
    return found.select(
        "seg_id",
        *[
            F.coalesce(F.col(f"`{n}`"), F.lit(missing)).cast("bigint" if t == "int" else "float").alias(n)
            for n, t in columns
        ],
    )
