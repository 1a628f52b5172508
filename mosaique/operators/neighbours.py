"""Neighbourhoods as equi-joins on exploded offsets, and what is computed from them.

A theta join of the 3x3 window would compare all pairs; each pixel is exploded to
its neighbours' positions instead, and off-grid positions vanish in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaique.functions.geo import easting, northing

OFFSETS_4 = [(-1, 0), (0, -1), (0, 1), (1, 0)]
OFFSETS_8 = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def offsets(four_connected: bool, forward: bool = False) -> list[tuple[int, int]]:
    """(row, column) steps in scan order; ``forward`` gives each undirected pair once."""
    own = OFFSETS_4 if four_connected else OFFSETS_8
    return [o for o in own if o > (0, 0)] if forward else own


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0)
    for x, y in zip(a, b):
        out = out + (x - y) * (x - y)
    return out


def neighbour_pairs(pixels: DataFrame, four_connected: bool = True, forward: bool = False) -> DataFrame:
    """Each pixel with each of its neighbours, whose columns are prefixed by ``n_``."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets(four_connected, forward)])
    left = pixels.withColumn("_o", F.explode(steps)).withColumns(
        {"n_row": F.col("row") + F.col("_o.dr"), "n_col": F.col("col") + F.col("_o.dc")}
    )
    right = pixels.select(*[F.col(c).alias(f"n_{c}") for c in pixels.columns])
    return left.drop("_o").join(right, ["n_row", "n_col"])


def adjacent_segments(seg: DataFrame, four_connected: bool = True) -> DataFrame:
    """(a, b) of segments that touch, in both directions, without segment 0."""
    own = seg.where("seg_id <> 0").select("row", "col", "seg_id")
    pairs = neighbour_pairs(own, four_connected, forward=True).where("seg_id <> n_seg_id")
    pairs = pairs.select(F.least("seg_id", "n_seg_id").alias("a"), F.greatest("seg_id", "n_seg_id").alias("b")).distinct()
    # both directions from one reading of the pairs
    return pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def edge_pixel_counts(valid: DataFrame, four_connected: bool = True) -> DataFrame:
    """(seg_id, n_edge): valid pixels (row, col, seg_id) with a neighbour outside the segment's valid pixels."""
    full = len(offsets(four_connected))
    pairs = neighbour_pairs(valid.select("row", "col", "seg_id"), four_connected)
    inner = pairs.where("seg_id = n_seg_id").groupBy("row", "col", "seg_id").agg(F.count("*").alias("k"))
    whole = inner.where(F.col("k") == full).groupBy("seg_id").agg(F.count("*").alias("whole"))
    sizes = valid.groupBy("seg_id").agg(F.count("*").alias("n"))
    return sizes.join(whole, "seg_id", "left").select("seg_id", (F.col("n") - F.coalesce("whole", F.lit(0))).alias("n_edge"))


def variogram(valid: DataFrame, max_dist: int, band: str = "b1", missing: float = -9999) -> DataFrame:
    """(seg_id, variogram1..m): root mean squared differences of pairs that many pixels apart, rounded down.

    Only pairs of which one lies below and to the right of the other count; a bin without pairs is missing.
    """
    own = valid.where(F.col(band).isNotNull()).select("seg_id", "row", "col", F.col(band).alias("v"))
    span = F.sequence(F.lit(1), F.lit(max_dist))
    ahead = own.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    ahead = ahead.withColumn("bin", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("int"))
    ahead = ahead.where(F.col("bin") <= max_dist)
    ahead = ahead.select(
        "seg_id", "v", "bin", (F.col("row") + F.col("dy")).alias("row"), (F.col("col") + F.col("dx")).alias("col")
    )
    pairs = ahead.join(own.withColumnRenamed("v", "w"), ["seg_id", "row", "col"])
    square = (F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))
    bins = [
        F.coalesce(F.sqrt(F.avg(F.when(F.col("bin") == i, square))), F.lit(float(missing))).alias(f"variogram{i}")
        for i in range(1, max_dist + 1)
    ]
    found = pairs.groupBy("seg_id").agg(*bins)
    every = own.select("seg_id").distinct()
    fill = {f"variogram{i}": float(missing) for i in range(1, max_dist + 1)}
    return every.join(found, "seg_id", "left").fillna(fill)


def mean_coordinates(valid: DataFrame, gt: list[float]) -> DataFrame:
    """(seg_id, easting, northing): means of the valid pixels' top-left corners."""
    return valid.groupBy("seg_id").agg(
        F.avg(easting(gt, F.col("col"), F.col("row"))).alias("easting"),
        F.avg(northing(gt, F.col("col"), F.col("row"))).alias("northing"),
    )
