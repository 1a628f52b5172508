"""Rasters as tables: reading, windows, sampling, metadata and writing.

A raster is ``pixel(row INT, col INT, b1..bN BIGINT)``, NULL for no-data; its
metadata is one row of :data:`META`. The canonical store is Parquet partitioned
by blocks of rows, so a window prunes partitions and columns prune bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of a storage block, and of the blocks in which sampling restarts.
BLOCK = 1024

META = "xsize int, ysize int, proj string, gt array<double>, nodata array<double>, md map<string,string>"

IDENTITY = [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


class RasterError(ValueError):
    """A raster that does not meet an operator's conditions."""


def events_raster(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """The ``events`` table as a raster: b1 value, b2 user, b3 hour, and the type as ``kind``."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.expr(f"cast(event_id div {width} as int)").alias("row"),
        F.expr(f"cast(event_id % {width} as int)").alias("col"),
        F.floor("value").cast("bigint").alias("b1"),
        F.col("user_id").alias("b2"),
        F.hour("ts").cast("bigint").alias("b3"),
        F.col("event_type").alias("kind"),
    )


def bands_of(pixels: DataFrame) -> list[str]:
    """Names of the band columns, in order."""
    own = [c for c in pixels.columns if c[:1] == "b" and c[1:].isdigit()]
    return sorted(own, key=lambda c: int(c[1:]))


def select_bands(pixels: DataFrame, numbers: list[int]) -> DataFrame:
    """Bands by 1-based number, renamed b1.. in the order given."""
    return pixels.select("row", "col", *[F.col(f"b{n}").alias(f"b{i}") for i, n in enumerate(numbers, 1)])


def with_nodata(pixels: DataFrame, nodata: int | None) -> DataFrame:
    """Bands widened to BIGINT with the no-data value as NULL."""
    bands = bands_of(pixels)
    wide = {b: F.col(b).cast("bigint") for b in bands}
    if nodata is not None:
        wide = {b: F.when(c != nodata, c) for b, c in wide.items()}
    return pixels.withColumns(wide)


def is_null(pixels: DataFrame) -> Column:
    """A pixel is null where any band is."""
    out = F.lit(False)
    for b in bands_of(pixels):
        out = out | F.col(b).isNull()
    return out


def window(pixels: DataFrame, xoff: int, yoff: int, xsize: int, ysize: int) -> DataFrame:
    """The pixels of a window, in the raster's own coordinates."""
    return pixels.where(
        F.col("row").between(yoff, yoff + ysize - 1) & F.col("col").between(xoff, xoff + xsize - 1)
    )


def subsample(pixels: DataFrame, prop: float, block: int = BLOCK) -> DataFrame:
    """Every round(1/prop)-th row and column, starting anew in each block."""
    skip = max(1, round(1 / prop))
    return pixels.where(f"(row % {block}) % {skip} = 0 AND (col % {block}) % {skip} = 0")


def common_nodata(meta: DataFrame, bands: list[int] | None = None) -> float | None:
    """The no-data value of the bands; an error where they differ."""
    values = meta.select("nodata").first()[0]
    own = {values[b - 1] for b in bands} if bands else set(values)
    if len(own) > 1:
        raise RasterError(f"bands have different no-data values: {sorted(map(str, own))}")
    return own.pop() if own else None


def check_aligned(seg_meta: DataFrame, img_meta: DataFrame) -> None:
    """Both rasters must have the same size, transform and projection."""
    a, b = seg_meta.first(), img_meta.first()
    for name in ("xsize", "ysize", "gt", "proj"):
        if a[name] != b[name]:
            raise RasterError(f"{name} differs: {a[name]} and {b[name]}")


def check_integer(pixels: DataFrame, bands: list[str]) -> None:
    """Statistics are defined for integer bands alone."""
    kinds = dict(pixels.dtypes)
    wrong = [b for b in bands if kinds[b] not in ("tinyint", "smallint", "int", "bigint")]
    if wrong:
        raise RasterError(f"not integer: {', '.join(wrong)}")


def meta_of(
    spark: SparkSession,
    xsize: int,
    ysize: int,
    proj: str = "",
    gt: list[float] | None = None,
    nodata: list[float | None] | None = None,
    md: dict[str, str] | None = None,
) -> DataFrame:
    return spark.createDataFrame([(xsize, ysize, proj, gt or IDENTITY, nodata or [], md or {})], META)


def write(pixels: DataFrame, path: str, block: int = BLOCK) -> None:
    """Parquet partitioned by blocks of rows and sorted within, so windows prune files and row groups."""
    (
        pixels.withColumn("block", F.expr(f"row div {block}"))
        .repartition("block", F.expr(f"col div {block}"))
        .sortWithinPartitions("block", "row", "col")
        .write.partitionBy("block")
        .parquet(path)
    )


def write_meta(meta: DataFrame, path: str) -> None:
    """A raster's one row of metadata, in a folder inside its own that readers of pixels pass over."""
    meta.coalesce(1).write.parquet(f"{path}/_meta")


def read_meta(spark: SparkSession, path: str) -> DataFrame | None:
    """The metadata of a raster written with it, else None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_meta")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(META).parquet(f"{path}/_meta")


def read(spark: SparkSession, path: str, win: tuple[int, int, int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """A raster written by :func:`write`, or one window (xoff, yoff, xsize, ysize) of it."""
    pixels = spark.read.parquet(path)
    if win:
        _, yoff, _, ysize = win
        pixels = window(pixels.where(F.col("block").between(yoff // block, (yoff + ysize - 1) // block)), *win)
    return pixels.drop("block")


def read_segments(spark: SparkSession, path: str, win: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A segment raster with its ids as BIGINT."""
    return read(spark, path, win).withColumn("seg_id", F.col("seg_id").cast("bigint"))
