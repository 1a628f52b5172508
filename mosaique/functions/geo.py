"""Affine transforms between pixels and map coordinates, and windows derived from them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaique.sources.raster import RasterError


def easting(gt: list[float], col: Column, row: Column) -> Column:
    """Map x of a pixel's top-left corner."""
    return F.lit(gt[0]) + F.lit(gt[1]) * col + F.lit(gt[2]) * row


def northing(gt: list[float], col: Column, row: Column) -> Column:
    return F.lit(gt[3]) + F.lit(gt[4]) * col + F.lit(gt[5]) * row


def to_pixel(gt: list[float], x: float, y: float) -> tuple[float, float]:
    """(column, row) of a map position."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = x - gt[0], y - gt[3]
    return (gt[5] * dx - gt[2] * dy) / det, (gt[1] * dy - gt[4] * dx) / det


def box_window(
    gt: list[float], xsize: int, ysize: int, ulx: float, uly: float, lrx: float, lry: float
) -> tuple[int, int, int, int]:
    """(xoff, yoff, xsize, ysize) of a map box: its top-left rounded down, its bottom-right up."""
    x0, y0 = to_pixel(gt, ulx, uly)
    x1, y1 = to_pixel(gt, lrx, lry)
    left, top, right, bottom = int(x0), int(y0), math.ceil(x1), math.ceil(y1)
    if left < 0 or top < 0 or right > xsize or bottom > ysize or right <= left or bottom <= top:
        raise RasterError("the box is not inside the raster")
    return left, top, right - left, bottom - top


def mask_window(
    gt: list[float], xsize: int, ysize: int, proj: str, mask_gt: list[float], mask_xsize: int, mask_ysize: int, mask_proj: str
) -> tuple[int, int, int, int]:
    """The window that a mask covers; its grid and projection must be the raster's."""
    if proj != mask_proj:
        raise RasterError("the mask has another projection")
    if (gt[1], gt[5]) != (mask_gt[1], mask_gt[5]):
        raise RasterError("the mask has another pixel size")
    x, y = to_pixel(gt, mask_gt[0], mask_gt[3])
    if x != round(x) or y != round(y):
        raise RasterError("the mask is not on the raster's grid")
    right, bottom = round(x) + mask_xsize, round(y) + mask_ysize
    if x < 0 or y < 0 or right > xsize or bottom > ysize:
        raise RasterError("the mask is not inside the raster")
    return round(x), round(y), mask_xsize, mask_ysize


def shifted(gt: list[float], xoff: int, yoff: int) -> list[float]:
    """The transform of a window."""
    return [gt[0] + xoff * gt[1] + yoff * gt[2], *gt[1:3], gt[3] + xoff * gt[4] + yoff * gt[5], *gt[4:]]
