"""Segmentation of one tile in NumPy, with the rules of :mod:`mosaique.operators.segmentation`.

A tile is what one task holds, so the tiled pipeline runs this per tile; the
tests use it as a second implementation of the whole-raster operators.
"""

from __future__ import annotations

import numpy as np

from mosaique.operators.neighbours import offsets


def shift(a: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
    """The neighbour (dr, dc) of each cell of ``a``, ``fill`` off the grid."""
    out = np.full_like(a, fill)
    h, w = a.shape
    rows, cols = slice(max(0, -dr), h - max(0, dr)), slice(max(0, -dc), w - max(0, dc))
    out[rows, cols] = a[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)]
    return out


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def assign(bands: np.ndarray, valid: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """1-based nearest centre per cell of ``bands`` (n, rows, cols); 0 where not valid."""
    best, out = np.full(valid.shape, np.inf), np.zeros(valid.shape, np.int64)
    for i, c in enumerate(centres, 1):
        d = ((bands - c[:, None, None]) ** 2).sum(axis=0)
        closer = d < best
        best[closer], out[closer] = d[closer], i
    return np.where(valid, out, 0)


def clump(value: np.ndarray, four_connected: bool = True) -> np.ndarray:
    """Components of equal non-zero value, numbered from 1 in scan order."""
    place = np.arange(value.size).reshape(value.shape)
    a, b = [], []
    for dr, dc in offsets(four_connected, forward=True):
        same = (shift(value, dr, dc, 0) == value) & (value != 0)
        a.append(place[same])
        b.append(shift(place, dr, dc, -1)[same])
    label = components(value.size, np.concatenate(a), np.concatenate(b))
    label[value.ravel() == 0] = -1
    ids = np.unique(label[label >= 0])
    out = np.zeros(value.size, np.int64)
    has = label >= 0
    out[has] = np.searchsorted(ids, label[has]) + 1
    return out.reshape(value.shape)


def merge_singles(seg: np.ndarray, bands: np.ndarray, four_connected: bool = True) -> np.ndarray:
    """Rounds in which each single pixel joins the nearest neighbour of a larger segment."""
    seg = seg.copy()
    while True:
        size = np.bincount(seg.ravel())
        alone = (seg != 0) & (size[seg] == 1)
        best, target = np.full(seg.shape, np.inf), np.zeros_like(seg)
        for dr, dc in offsets(four_connected):  # in scan order, so the first of equals stays
            other = shift(seg, dr, dc, 0)
            d = sum((b - shift(b, dr, dc, 0)) ** 2 for b in bands).astype(float)
            closer = alone & (other != 0) & (size[other] > 1) & (d < best)
            best[closer], target[closer] = d[closer], other[closer]
        if not target.any():
            return seg
        seg = np.where(target != 0, target, seg)


def merge_small(
    seg: np.ndarray, bands: np.ndarray, min_size: int, max_diff: float, four_connected: bool = True, passes: int = 10
) -> np.ndarray:
    """Segments below ``min_size`` join the touching larger one with the nearest mean, sizes in ascending order."""
    flat = seg.ravel()
    size = np.bincount(flat).astype(np.int64)
    sums = np.stack([np.bincount(flat, b.ravel(), len(size)) for b in bands.astype(float)])
    near: dict[int, set[int]] = {}
    for dr, dc in offsets(four_connected, forward=True):
        other = shift(seg, dr, dc, 0)
        touch = (seg != other) & (seg != 0) & (other != 0)
        pairs = np.unique(seg[touch].astype(np.int64) * len(size) + other[touch])
        for x, y in zip((pairs // len(size)).tolist(), (pairs % len(size)).tolist()):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    now = np.arange(len(size))
    for t in range(1, min_size):
        for _ in range(passes):
            targets = []
            for s in np.flatnonzero(size == t).tolist():
                found = [
                    (float((((sums[:, s] / t) - (sums[:, o] / size[o])) ** 2).sum()), o)
                    for o in near.get(s, ())
                    if s and size[o] > t
                ]
                if found and min(found)[0] <= max_diff * max_diff:
                    targets.append((s, min(found)[1]))
            for s, o in targets:
                size[o] += size[s]
                sums[:, o] += sums[:, s]
                size[s] = 0
                for x in near.pop(s):
                    near[x].discard(s)
                    if x != o:
                        near[x].add(o)
                        near[o].add(x)
                now[s] = o
            if not targets:
                break
    while not np.array_equal(jumped := now[now], now):
        now = jumped
    return now[seg]


def relabel(seg: np.ndarray) -> np.ndarray:
    ids = np.unique(seg[seg != 0])
    return np.where(seg != 0, np.searchsorted(ids, seg) + 1, 0)


def segment(
    bands: np.ndarray, valid: np.ndarray, centres: np.ndarray, min_size: int, max_diff: float, four_connected: bool = True
) -> np.ndarray:
    """Segment ids of a tile's cells, 0 where not valid."""
    seg = clump(assign(bands, valid, centres), four_connected)
    seg = relabel(merge_singles(seg, bands, four_connected))
    return relabel(merge_small(seg, bands, min_size, max_diff, four_connected))
