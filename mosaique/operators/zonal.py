"""Zonal statistics: one aggregation over (segment raster, image raster).

Segment 0 is no segment. All statistics of all bands come from a single groupBy;
a segment without valid pixels has the missing value in each statistic but
``pixcount``, which is 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaique.functions.stats import COUNTS, MISSING, kind_of, stat
from mosaique.sources.raster import RasterError, check_integer

HISTOGRAM = "Histogram"


@dataclass(frozen=True)
class Stat:
    """A column ``name`` that holds statistic ``stat`` (with ``param``) of ``band``."""

    name: str
    stat: str
    band: str = "b1"
    param: float = 0


def named_stats(bands: Sequence[int], specs: Sequence[str | tuple[str, float]]) -> list[Stat]:
    """Columns ``Band_{b}_{stat}``, or ``Band_{b}_pcnt{p}`` for percentiles, of every band and statistic."""
    out = []
    for b in bands:
        for spec in specs:
            name, p = (spec, 0) if isinstance(spec, str) else spec
            label = f"pcnt{int(p)}" if name == "percentile" else name
            out.append(Stat(f"Band_{b}_{label}", name, f"b{b}", p))
    return out


def overlay(seg: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels with their segment, by position; those of no segment left out."""
    return seg.where("seg_id <> 0").select("row", "col", "seg_id").join(pixels, ["row", "col"])


def zonal_stats(valued: DataFrame, selection: Sequence[Stat], missing: float | None = MISSING) -> DataFrame:
    """(seg_id, one column per statistic) of ``valued`` (seg_id and band columns, NULL for no-data)."""
    check_integer(valued, sorted({s.band for s in selection}))
    found = valued.where("seg_id <> 0").groupBy("seg_id").agg(*[stat(s.stat, s.band, s.param).alias(s.name) for s in selection])
    return fill_missing(found, selection, missing)


def fill_missing(found: DataFrame, selection: Sequence[Stat], missing: float | None) -> DataFrame:
    def out(s: Stat):
        c = F.col(f"`{s.name}`")
        if missing is not None and s.stat not in COUNTS:
            c = F.coalesce(c, F.lit(missing).cast(kind_of(s.stat)))
        return c.cast(kind_of(s.stat)).alias(s.name)

    return found.select("seg_id", *map(out, selection))


def add_to_table(rat: DataFrame, stats: DataFrame, selection: Sequence[Stat], missing: float = MISSING) -> DataFrame:
    """The attribute table with statistics added; a column of the same name must have the same type and is replaced."""
    check_histogram(rat)
    kinds = dict(rat.dtypes)
    for s in selection:
        if s.name in kinds and kinds[s.name] != kind_of(s.stat):
            raise RasterError(f"column {s.name} is {kinds[s.name]}, not {kind_of(s.stat)}")
    old = rat.drop(*[s.name for s in selection])
    joined = old.join(stats, "seg_id", "left")
    filled = {}
    for s in selection:
        default = F.lit(0 if s.stat in COUNTS else missing).cast(kind_of(s.stat))
        filled[s.name] = F.coalesce(F.col(f"`{s.name}`"), default)
    return joined.withColumns(filled)


def check_histogram(rat: DataFrame) -> None:
    if HISTOGRAM not in rat.columns:
        raise RasterError(f"the attribute table has no column {HISTOGRAM}")


def segment_sizes(seg: DataFrame, with_null: bool = False) -> DataFrame:
    """(seg_id, n) pixels of each segment."""
    return (seg if with_null else seg.where("seg_id <> 0")).groupBy("seg_id").agg(F.count("*").alias("n"))


def merge_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of two histograms (seg_id, n)."""
    return a.unionByName(b).groupBy("seg_id").agg(F.sum("n").alias("n"))


def value_histogram(valued: DataFrame, band: str = "b1") -> DataFrame:
    """(seg_id, value, n) of valid pixels."""
    own = valued.where("seg_id <> 0").where(F.col(band).isNotNull())
    return own.groupBy("seg_id", F.col(band).alias("value")).agg(F.count("*").alias("n"))


def nodata_counts(valued: DataFrame, band: str = "b1") -> DataFrame:
    """(seg_id, n_valid, n_nodata) of each segment."""
    return valued.where("seg_id <> 0").groupBy("seg_id").agg(
        F.count(band).alias("n_valid"), F.count_if(F.col(band).isNull()).alias("n_nodata")
    )


def spectral_sums(valued: DataFrame, bands: Sequence[str]) -> DataFrame:
    """(seg_id, n, exact sums s1.. of the bands)."""
    sums = [F.sum(b).cast("bigint").alias(f"s{i}") for i, b in enumerate(bands, 1)]
    return valued.where("seg_id <> 0").groupBy("seg_id").agg(F.count("*").alias("n"), *sums)


def incomplete_segments(rat: DataFrame, valued: DataFrame) -> DataFrame:
    """(seg_id, expected, found) where the pixels seen do not match the histogram; those without any have found 0."""
    check_histogram(rat)
    seen = valued.where("seg_id <> 0").groupBy("seg_id").agg(F.count("*").alias("found"))
    want = rat.where("seg_id <> 0").select("seg_id", F.col(HISTOGRAM).alias("expected"))
    both = want.join(seen, "seg_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where("expected <> found")


def empty_segments(sizes: DataFrame) -> DataFrame:
    """Ids from 1 to the largest without pixels."""
    top = sizes.agg(F.max("seg_id")).first()[0] or 0
    wanted = sizes.sparkSession.range(1, top + 1).select(F.col("id").alias("seg_id"))
    return wanted.join(sizes.where("n > 0"), "seg_id", "left_anti")


def has_empty_segments(sizes: DataFrame) -> bool:
    """Whether an id from 1 to the largest has no pixels, by counting; ids are distinct."""
    row = sizes.where("seg_id > 0 AND n > 0").agg(F.count("*").alias("k"), F.max("seg_id").alias("top")).first()
    return row["k"] != (row["top"] or 0)


def histogram_summary(sizes: DataFrame) -> DataFrame:
    """Weighted min, max, mean, population deviation, mode (lowest of ties) and median of the ids themselves.

    The median is the first id whose cumulative count reaches half of all.
    """
    weight = F.sum("n")
    mean = F.sum(F.col("seg_id") * F.col("n")) / weight
    whole = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("most"), mean.alias("mean")).first()
    # prefix sums over ranges of ids: counts per range first, then within each
    part = F.expr("seg_id div 4096")
    ranges = sizes.groupBy(part.alias("part")).agg(F.sum("n").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = (
        sizes.withColumn("part", part)
        .join(ranges, "part")
        .withColumn("cum", F.col("base") + F.sum("n").over(inner))
    )
    away = F.col("seg_id") - F.lit(whole["mean"])  # squares of the ids themselves would cancel
    return cum.agg(
        F.min("seg_id").alias("minimum"),
        F.max("seg_id").alias("maximum"),
        mean.alias("mean"),
        F.sqrt(F.sum(away * away * F.col("n")) / weight).alias("stddev"),
        F.min(F.when(F.col("n") == F.lit(whole["most"]), F.col("seg_id"))).alias("mode"),
        F.min(F.when(F.col("cum") * 2 >= F.lit(whole["total"]), F.col("seg_id"))).alias("median"),
    )
