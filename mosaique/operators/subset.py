"""Subsets of a segment raster: a window or mask, ids anew, attribute rows carried over."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaique.operators.segmentation import dense_ids
from mosaique.operators.zonal import HISTOGRAM
from mosaique.sources.raster import BLOCK, RasterError, window


@dataclass
class Subset:
    """seg (row, col, seg_id) from (0, 0), the attribute table, and recode (old_id, seg_id)."""

    seg: DataFrame
    rat: DataFrame
    recode: DataFrame


def check_window(xsize: int, ysize: int, xoff: int, yoff: int, wx: int, wy: int) -> None:
    if xoff < 0 or yoff < 0 or wx <= 0 or wy <= 0 or xoff + wx > xsize or yoff + wy > ysize:
        raise RasterError("the window is not inside the raster")


def masked(seg: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels where ``mask`` (row, col, m) is not 0."""
    return seg.join(mask.where("m <> 0").select("row", "col"), ["row", "col"], "left_semi")


def first_seen(seg: DataFrame, xoff: int = 0, yoff: int = 0, block: int = BLOCK) -> DataFrame:
    """(old_id, seg_id): ids in the order in which segments appear, block by block and row by row."""
    order = F.struct(
        F.expr(f"(row - {yoff}) div {block}").alias("brow"),
        F.expr(f"(col - {xoff}) div {block}").alias("bcol"),
        "row",
        "col",
    )
    first = seg.where("seg_id <> 0").groupBy("seg_id").agg(F.min(order).alias("first"))
    ids = dense_ids(first, "first", "new_id")
    return first.join(ids, "first").select(F.col("seg_id").alias("old_id"), F.col("new_id").cast("bigint").alias("seg_id"))


def carry_rows(rat: DataFrame, recode: DataFrame) -> DataFrame:
    """Attribute rows of the segments that stay, under their new ids; text columns are refused."""
    text = [c for c, kind in rat.dtypes if kind == "string"]
    if text:
        raise RasterError(f"text columns cannot be carried over: {', '.join(text)}")
    return rat.withColumnRenamed("seg_id", "old_id").join(recode, "old_id")


def subset(
    seg: DataFrame,
    rat: DataFrame,
    xoff: int,
    yoff: int,
    wx: int,
    wy: int,
    size: tuple[int, int] | None = None,
    mask: DataFrame | None = None,
    orig_id_column: str | None = None,
    block: int = BLOCK,
) -> Subset:
    """The window of ``seg`` with ids from 1, its own histogram and the other attributes of ``rat``.

    ``mask`` is in the window's coordinates; ``size`` (xsize, ysize), where given, is checked.
    """
    if size:
        check_window(*size, xoff, yoff, wx, wy)
    own = window(seg, xoff, yoff, wx, wy)
    if mask is not None:
        own = masked(own, mask.select((F.col("row") + yoff).alias("row"), (F.col("col") + xoff).alias("col"), "m"))
    recode = first_seen(own, xoff, yoff, block)
    moved = own.withColumnRenamed("seg_id", "old_id").join(recode, "old_id", "left").select(
        (F.col("row") - yoff).cast("int").alias("row"),
        (F.col("col") - xoff).cast("int").alias("col"),
        F.coalesce("seg_id", F.lit(0)).cast("bigint").alias("seg_id"),
    )
    sizes = moved.where("seg_id <> 0").groupBy("seg_id").agg(F.count("*").alias(HISTOGRAM))
    table = carry_rows(rat, recode).drop(HISTOGRAM).join(sizes, "seg_id")
    if orig_id_column:
        table = table.withColumn(orig_id_column, F.col("old_id"))
    return Subset(moved, table.drop("old_id"), recode)
