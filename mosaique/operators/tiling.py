"""Tiled segmentation: overlapping tiles, one task each, stitched by joins.

Tiles are in (row, column) order. A tile's segments that cross the middle of the
strip it shares with the tile to its left or above take the segment that most of
their pixels there have in that tile (left wins over above). These links form
chains, which pointer jumping resolves in a logarithmic number of rounds; the
roots whose bounding box begins inside their tile's trimmed part are numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaique.operators import cluster as km
from mosaique.operators import kernel
from mosaique.operators.graph import cut, cut_wide, drop_cut
from mosaique.operators.segmentation import Segmentation, dense_ids
from mosaique.sources.raster import RasterError, bands_of

TILE, OVERLAP = 4096, 1024


@dataclass(frozen=True)
class Axis:
    """Tiles along one axis: steps of tile - overlap; the last grows to the edge rather than leave a sliver."""

    size: int
    tile: int
    overlap: int

    def __post_init__(self):
        if self.overlap % 2 or not 0 <= self.overlap < self.tile:
            raise RasterError("the overlap must be even and smaller than the tile")

    @property
    def step(self) -> int:
        return self.tile - self.overlap

    @property
    def last(self) -> int:
        i = 0
        while i * self.step + 2 * self.tile <= self.size:
            i += 1
        return i

    def spans(self) -> list[tuple[int, int]]:
        """(start, length) of each tile."""
        n = self.last
        return [(i * self.step, self.tile if i < n else self.size - i * self.step) for i in range(n + 1)]

    def tiles_of(self, position: str):
        """An array of the numbers of the tiles that hold a position, by arithmetic."""
        first = F.ceil((F.col(position) - F.lit(self.tile - 1)) / F.lit(self.step)).cast("int")
        last = F.lit(self.last)
        low = F.least(last, F.greatest(F.lit(0), first))
        return F.sequence(low, F.least(last, F.expr(f"cast({position} div {self.step} as int)")))


def grid(xsize: int, ysize: int, tile: int = TILE, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int, int]]:
    """(tcol, trow, xpos, ypos, xsize, ysize) of each tile, in order."""
    xs, ys = Axis(xsize, tile, overlap).spans(), Axis(ysize, tile, overlap).spans()
    return [(i, j, x, y, w, h) for j, (y, h) in enumerate(ys) for i, (x, w) in enumerate(xs)]


TILES = "tcol int, trow int, xpos int, ypos int, xsize int, ysize int, left int, right int, top int, bottom int"


def tile_table(spark: SparkSession, xsize: int, ysize: int, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """The grid with each tile's trimmed part [left, right) x [top, bottom): half an overlap less at inner sides."""
    m = overlap // 2
    rows = grid(xsize, ysize, tile, overlap)
    cols, lines = max(r[0] for r in rows), max(r[1] for r in rows)
    return spark.createDataFrame(
        [
            (i, j, x, y, w, h, x + m * (i > 0), x + w - m * (i < cols), y + m * (j > 0), y + h - m * (j < lines))
            for i, j, x, y, w, h in rows
        ],
        TILES,
    )


def explode_tiles(pixels: DataFrame, xsize: int, ysize: int, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """Each pixel once per tile that holds it (1, 2 or 4 times), without a join."""
    xs, ys = Axis(xsize, tile, overlap), Axis(ysize, tile, overlap)
    return pixels.withColumn("tcol", F.explode(xs.tiles_of("col"))).withColumn("trow", F.explode(ys.tiles_of("row")))


def segment_tiles(
    pixels: DataFrame, xsize: int, ysize: int, centres: list, min_size: int, max_diff: float,
    four_connected: bool = True, tile: int = TILE, overlap: int = OVERLAP,
) -> DataFrame:
    """(tcol, trow, row, col, local_id): each tile segmented by itself in one task."""
    bands = bands_of(pixels)
    middle = np.array([c for _, c in centres])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = r.min(), c.min()
        shape = (r.max() - r0 + 1, c.max() - c0 + 1)
        data, valid = np.zeros((len(bands), *shape), np.int64), np.zeros(shape, bool)
        whole = ~pdf[bands].isna().any(axis=1).to_numpy()
        valid[r[whole] - r0, c[whole] - c0] = True
        for i, b in enumerate(bands):
            data[i, r[whole] - r0, c[whole] - c0] = pdf[b].to_numpy()[whole]
        seg = kernel.segment(data, valid, middle, min_size, max_diff, four_connected)
        return pd.DataFrame(
            {"tcol": key[0], "trow": key[1], "row": r, "col": c, "local_id": seg[r - r0, c - c0]}
        ).astype({"tcol": "int32", "trow": "int32"})

    return (
        explode_tiles(pixels, xsize, ysize, tile, overlap)
        .groupBy("tcol", "trow")
        .applyInPandas(run, "tcol int, trow int, row int, col int, local_id long")
    )


def crossing(strip: DataFrame, overlap: int) -> DataFrame:
    """Segments of a strip that cross its middle: smallest < middle <= largest.

    ``strip`` has tcol, trow, local_id and ``at``, the place across the strip from its start.
    """
    mid = overlap // 2
    return (
        strip.where("local_id <> 0")
        .groupBy("tcol", "trow", "local_id")
        .agg(F.min("at").alias("low"), F.max("at").alias("high"))
        .where((F.col("low") < mid) & (F.col("high") >= mid))
        .select("tcol", "trow", "local_id")
    )


def overlap_links(tile_seg: DataFrame, tiles: DataFrame, overlap: int) -> DataFrame:
    """(tcol, trow, local_id, to_tcol, to_trow, to_id): what crossing segments are called in an earlier tile."""
    placed = tile_seg.join(F.broadcast(tiles.select("tcol", "trow", "xpos", "ypos")), ["tcol", "trow"])
    out = []
    for dx, dy, at, rank in ((1, 0, F.col("col") - F.col("xpos"), 0), (0, 1, F.col("row") - F.col("ypos"), 1)):
        has_other = F.col("tcol") > 0 if dx else F.col("trow") > 0
        strip = placed.withColumn("at", at).where(has_other & (F.col("at") < overlap))
        own = strip.join(crossing(strip, overlap), ["tcol", "trow", "local_id"])
        own = own.withColumns({"to_tcol": F.col("tcol") - dx, "to_trow": F.col("trow") - dy})
        other = tile_seg.select(
            F.col("tcol").alias("to_tcol"), F.col("trow").alias("to_trow"), "row", "col", F.col("local_id").alias("to_id")
        )
        both = own.join(other, ["to_tcol", "to_trow", "row", "col"])
        named = both.groupBy("tcol", "trow", "local_id", "to_tcol", "to_trow").agg(F.mode("to_id", True).alias("to_id"))
        out.append(named.withColumn("rank", F.lit(rank)))
    pick = F.min(F.struct("rank", "to_tcol", "to_trow", "to_id")).alias("x")
    found = out[0].unionByName(out[1]).groupBy("tcol", "trow", "local_id").agg(pick)
    return found.select("tcol", "trow", "local_id", "x.to_tcol", "x.to_trow", "x.to_id")


def box_owners(tile_seg: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tcol, trow, local_id, owned): whether the corner of a segment's box lies in its tile's trimmed part."""
    box = tile_seg.where("local_id <> 0").groupBy("tcol", "trow", "local_id").agg(
        F.min("row").alias("row"), F.min("col").alias("col")
    )
    inside = F.expr("col >= left AND col < right AND row >= top AND row < bottom")
    return box.join(F.broadcast(tiles), ["tcol", "trow"]).select("tcol", "trow", "local_id", inside.alias("owned"))


def stitch(tile_seg: DataFrame, tiles: DataFrame, overlap: int, simple: bool = False) -> DataFrame:
    """(row, col, seg_id): the trimmed tiles put together.

    ``simple`` only makes ids distinct, by adding those of earlier tiles.
    """
    bounds = F.expr("col >= left AND col < right AND row >= top AND row < bottom")
    kept = tile_seg.join(F.broadcast(tiles), ["tcol", "trow"]).where(bounds).select("tcol", "trow", "row", "col", "local_id")
    if simple:
        roots = kept.where("local_id <> 0").select(_key())
        ids = dense_ids(roots, "key", "seg_id")
        named = kept.withColumn("key", _key()).join(ids.hint("merge"), "key", "left")
        return named.select("row", "col", F.coalesce("seg_id", F.lit(0)).cast("bigint").alias("seg_id"))
    links = overlap_links(tile_seg, tiles, overlap)
    start = links.select(_key(), F.struct(F.col("to_trow").alias("trow"), F.col("to_tcol").alias("tcol"), F.col("to_id").alias("local_id")).alias("to"))
    now = cut_wide(start)
    while True:
        step = now.select(F.col("key").alias("to"), F.col("to").alias("next"))
        new = cut_wide(now.join(step, "to", "left").select("key", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        drop_cut(now)
        path = getattr(new, "_cut_path", None)
        now = new.drop("moved")
        now._cut_path = path  # type: ignore[attr-defined]
        if not moved:
            break
    every = kept.where("local_id <> 0").select("tcol", "trow", "local_id").distinct()
    rooted = every.withColumn("key", _key()).join(now, "key", "left").withColumn("root", F.coalesce("to", "key"))
    owned = box_owners(tile_seg, tiles).where("owned").select(_key().alias("root"))
    ids = dense_ids(owned.join(rooted.select("root").distinct().hint("merge"), "root", "left_semi"), "root", "seg_id")
    named = rooted.join(ids.hint("merge"), "root", "left").select("tcol", "trow", "local_id", "seg_id")
    return kept.join(named.hint("merge"), ["tcol", "trow", "local_id"], "left").select(
        "row", "col", F.coalesce("seg_id", F.lit(0)).cast("bigint").alias("seg_id")
    )


def _key():
    return F.struct("trow", "tcol", "local_id").alias("key")


def segment_tiled(
    pixels: DataFrame, xsize: int, ysize: int, tile: int = TILE, overlap: int = OVERLAP, min_size: int = 50,
    clusters: int = 60, sample_percent: float | None = None, max_diff: str | float | None = "auto",
    fixed_init: bool = False, four_connected: bool = True, simple: bool = False, percentile: float = 50,
    centres: DataFrame | None = None,
) -> Segmentation:
    """Segment a raster by overlapping tiles; centres are fitted once for all of them."""
    if centres is None:
        percent = sample_percent or km.auto_proportion(xsize * ysize)[1]
        centres = km.fit(pixels, clusters, percent, fixed_init)
    limit = km.max_difference(centres, max_diff, percentile)
    rows = km.centre_rows(centres)
    tiled = cut_wide(segment_tiles(pixels, xsize, ysize, rows, min_size, limit, four_connected, tile, overlap))
    tiles = tile_table(pixels.sparkSession, xsize, ysize, tile, overlap)
    return Segmentation(cut(stitch(tiled, tiles, overlap, simple)), centres, limit)


