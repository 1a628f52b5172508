"""Raster attribute tables: columns, ranges, colours, overviews and timings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaique.functions.stats import MISSING
from mosaique.operators.graph import cut, drop_cut
from mosaique.operators.zonal import HISTOGRAM
from mosaique.sources.raster import RasterError

#: Rows of a page; a table may be partitioned by it.
PAGE = 100_000


def page_id(seg_id: Column) -> Column:
    """The first segment id of the page that holds ``seg_id``."""
    return (seg_id - F.pmod(seg_id, F.lit(PAGE))).cast("bigint")


def read_column(rat: DataFrame, name: str) -> DataFrame:
    if name not in rat.columns:
        raise RasterError(f"the attribute table has no column {name}")
    return rat.select("seg_id", name)


def read_range(rat: DataFrame, low: int, high: int) -> DataFrame:
    return rat.where(F.col("seg_id").between(low, high))


def add_columns(rat: DataFrame, new: DataFrame) -> DataFrame:
    """The table with columns of another by seg_id; columns of the same name and type are replaced."""
    kinds = dict(rat.dtypes)
    for name, kind in new.dtypes:
        if name != "seg_id" and kinds.get(name, kind) != kind:
            raise RasterError(f"column {name} is {kinds[name]}, not {kind}")
    return rat.drop(*[c for c in new.columns if c != "seg_id"]).join(new, "seg_id", "left")


def with_histogram(rat: DataFrame, sizes: DataFrame) -> DataFrame:
    """The table with the pixel counts of (seg_id, n) as its histogram column; 0 where there are none."""
    joined = rat.drop(HISTOGRAM).join(sizes.select("seg_id", F.col("n").alias(HISTOGRAM)), "seg_id", "left")
    return joined.fillna({HISTOGRAM: 0})


def pixel_attribute(seg: DataFrame, rat: DataFrame, name: str, missing: float = MISSING) -> DataFrame:
    """Each pixel with an attribute of its segment; ``missing`` where the table has no row for it, as for segment 0."""
    own = rat.where("seg_id <> 0").select("seg_id", F.lit(True).alias("_known"), F.col(f"`{name}`").alias("_value"))
    value = F.when(F.col("_known"), F.col("_value")).otherwise(F.lit(missing).cast(rat.schema[name].dataType))
    return seg.join(own, "seg_id", "left").withColumn(name, value).drop("_known", "_value")


def random_colours(ids: DataFrame, seed: int = 0) -> DataFrame:
    """(seg_id, Red, Green, Blue, Alpha): the same colours for the same seed; segment 0 is transparent."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("seg_id").cast("string")))
    part = {name: F.conv(digest.substr(2 * i + 1, 2), 16, 10).cast("int") for i, name in enumerate(("Red", "Green", "Blue"))}
    alpha = F.when(F.col("seg_id") == 0, 0).otherwise(255).cast("int")
    return ids.select("seg_id").withColumns(part | {"Alpha": alpha})


def exact_percentiles(df: DataFrame, name: str, shares: list[float]) -> list[float | None]:
    """Interpolated percentiles of a column, as ``percentile`` gives them, without gathering its values in one task.

    Values are dealt out by ranges; the ranks asked for are looked up in the ranges that hold them.
    """
    value = F.col(f"`{name}`").cast("double")
    parts = cut(
        df.select(value.alias("v")).where("v IS NOT NULL").repartitionByRange("v").select("v", F.spark_partition_id().alias("part"))
    )
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}  # a row for each range
    n, base, starts = sum(sizes.values()), 0, {}
    for p in sorted(sizes):
        starts[p], base = base, base + sizes[p]
    if not n:
        return [None for _ in shares]
    places = [(n - 1) * s for s in shares]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    held = {r: max(p for p in starts if starts[p] <= r) for r in ranks}
    wanted = F.lit(False)
    for r, p in held.items():
        wanted = wanted | ((F.col("part") == p) & (F.col("i") == r - starts[p] + 1))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("v"))
    rows = parts.where(F.col("part").isin(list(held.values()))).withColumn("i", rank).where(wanted).collect()
    at = {starts[r["part"]] + r["i"] - 1: r["v"] for r in rows}
    drop_cut(parts)
    low = [math.floor(x) for x in places]
    return [at[a] if a == x else (a + 1 - x) * at[a] + (x - a) * at[a + 1] for a, x in zip(low, places)]


def stretched_colours(rat: DataFrame, red: str, green: str, blue: str, low: float = 5, high: float = 95) -> DataFrame:
    """(seg_id, Red, Green, Blue, Alpha): columns stretched between two interpolated percentiles of all rows.

    A column whose percentiles are equal has colour 0.
    """
    names = {"Red": red, "Green": green, "Blue": blue}
    found = {c: exact_percentiles(rat, c, [low / 100, high / 100]) for c in set(names.values())}
    out = []
    for n, c in names.items():
        a, b = (x or 0.0 for x in found[c])
        value = F.lit(0.0) if a == b else (F.col(f"`{c}`") - F.lit(a)) / F.lit(b - a)
        clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
        out.append(F.floor(255 * clipped).cast("int").alias(n))
    return rat.select("seg_id", *out, F.lit(255).alias("Alpha"))


def fixed_levels(xsize: int, ysize: int) -> list[int]:
    """Overview levels 4 to 512 whose smaller side stays above 100."""
    return [lvl for lvl in (4, 8, 16, 32, 64, 128, 256, 512) if min(xsize, ysize) // lvl > 100]


def tiled_levels(xsize: int, ysize: int) -> list[int]:
    """Powers of two from 4 until the larger side falls below 1024."""
    size, out = max(xsize, ysize), []
    if size // 4 < 1024:
        return out
    out.append(4)
    while size // out[-1] >= 1024:
        out.append(2 * out[-1])
    return out


def overview(seg: DataFrame, level: int, xoff: int = 0, yoff: int = 0) -> DataFrame:
    """Every ``level``-th pixel from the middle of each cell of a block at (xoff, yoff)."""
    half = level // 2
    keep = f"pmod(row - {yoff}, {level}) = {half} AND pmod(col - {xoff}, {level}) = {half}"
    moved = {"row": F.expr(f"cast((row - {yoff}) div {level} + {yoff // level} as int)"), "col": F.expr(f"cast((col - {xoff}) div {level} + {xoff // level} as int)")}
    return seg.where(keep).withColumns(moved)


def timing_summary(timing: DataFrame) -> DataFrame:
    """(name, total, min, max, lowerq, median, upperq, mean, count) of (name, t0, t1)."""
    took = timing.select("name", (F.col("t1") - F.col("t0")).alias("d"))
    return took.groupBy("name").agg(
        F.sum("d").alias("total"),
        F.min("d").alias("min"),
        F.max("d").alias("max"),
        F.percentile("d", 0.25).alias("lowerq"),
        F.percentile("d", 0.5).alias("median"),
        F.percentile("d", 0.75).alias("upperq"),
        F.avg("d").alias("mean"),
        F.count("*").alias("count"),
    )
