import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaique.functions.stats import MISSING
from mosaique.operators import neighbours as nb
from mosaique.operators import rat, spatial, zonal
from mosaique.operators.zonal import Stat
from mosaique.sources.raster import RasterError
from tests.grids import pixels

ALL = [
    Stat("lo", "min"), Stat("hi", "max"), Stat("mean", "mean"), Stat("sd", "stddev"), Stat("mode", "mode"),
    Stat("median", "median"), Stat("p0", "percentile", param=0), Stat("p7", "percentile", param=7.9), Stat("n", "pixcount"),
]


def stats(spark, rows):
    df = spark.createDataFrame(rows, "seg_id bigint, b1 bigint")
    return {r["seg_id"]: r for r in zonal.zonal_stats(df, ALL).collect()}


def test_values_of_a_segment(spark):
    got = stats(spark, [(1, v) for v in (1, 1, 2, 2)] + [(2, None), (2, None), (0, 5), (3, None), (3, 7)])
    assert set(got) == {1, 2, 3}  # segment 0 is none
    r = got[1]
    assert (r["mode"], r["median"], r["lo"], r["hi"], r["p0"], r["n"]) == (1, 1, 1, 2, 2, 4)
    assert r["mean"] == 1.5 and r["sd"] == 0.5
    r = got[2]  # no valid pixel
    assert (r["lo"], r["mode"], r["median"], r["n"]) == (MISSING, MISSING, MISSING, 0) and r["mean"] == MISSING
    assert got[3]["n"] == 1 and got[3]["sd"] == 0


def test_percentile_rank_follows_double_arithmetic(spark):
    # 100 * (7 / 100) is 7.000000000000001, so the rank is 8
    assert stats(spark, [(1, v) for v in range(100)])[1]["p7"] == 7


def test_errors(spark):
    df = spark.createDataFrame([(1, 1.5)], "seg_id bigint, b1 double")
    with pytest.raises(RasterError):
        zonal.zonal_stats(df, ALL)
    with pytest.raises(KeyError):
        zonal.zonal_stats(df.withColumn("b1", F.col("b1").cast("bigint")), [Stat("x", "nonesuch")])
    with pytest.raises(RasterError):
        zonal.check_histogram(df)


def test_attribute_table(spark):
    table = spark.createDataFrame([(1, 2, 5), (2, 1, 6), (3, 1, 7)], "seg_id bigint, Histogram bigint, other bigint")
    valued = spark.createDataFrame([(1, 4), (1, 6), (2, None)], "seg_id bigint, b1 bigint")
    want = [Stat("mean", "mean"), Stat("n", "pixcount")]
    out = {r["seg_id"]: r for r in zonal.add_to_table(table, zonal.zonal_stats(valued, want), want).collect()}
    assert out[1]["mean"] == 5 and out[2]["mean"] == MISSING and out[3]["mean"] == MISSING
    assert [out[i]["n"] for i in (1, 2, 3)] == [2, 0, 0] and out[3]["other"] == 7
    missing = zonal.incomplete_segments(table, valued).collect()
    assert [(r["seg_id"], r["expected"], r["found"]) for r in missing] == [(3, 1, 0)]
    with pytest.raises(RasterError):
        zonal.add_to_table(table, spark.createDataFrame([(1, 1.0)], "seg_id bigint, other float"), [Stat("other", "mean")])


def test_empty_segments(spark):
    sizes = spark.createDataFrame([(1, 3), (4, 1)], "seg_id bigint, n bigint")
    assert sorted(r["seg_id"] for r in zonal.empty_segments(sizes).collect()) == [2, 3]
    assert zonal.has_empty_segments(sizes) and not zonal.has_empty_segments(sizes.where("seg_id = 1"))
    assert zonal.empty_segments(sizes.limit(0)).collect() == []


def test_colours_and_levels(spark):
    table = spark.createDataFrame([(i, float(i)) for i in range(101)], "seg_id bigint, x double").withColumn("flat", F.lit(3.0))
    out = {r["seg_id"]: r for r in rat.stretched_colours(table, "x", "x", "flat").collect()}
    assert out[0]["Red"] == 0 and out[100]["Red"] == 255 and out[50]["Red"] == 127 and out[50]["Blue"] == 0
    colours = rat.random_colours(table)
    assert colours.collect() == rat.random_colours(table).collect()
    assert colours.where("seg_id = 0").first()["Alpha"] == 0
    assert rat.tiled_levels(8000, 8000) == [4, 8] and rat.tiled_levels(1000, 1000) == []
    assert rat.fixed_levels(1000, 2000) == [4, 8]


def test_variogram_takes_pairs_to_the_lower_right(spark):
    # the two diagonals differ: only 0-3 counts at distance 1
    grid = np.array([[0, 10], [20, 3]])
    own = pixels(spark, grid).withColumn("seg_id", F.lit(1).cast("bigint"))
    assert nb.variogram(own, 1).first()["variogram1"] == 3.0
    got = spatial.spatial_stats(own, [("variogram1", "float")], "variogram", 1).first()
    assert got["variogram1"] == 3.0


def test_exact_percentiles_beside_percentile(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x),) for x in rng.integers(0, 40, 301)] + [(None,)], "v double").repartition(5)
    shares = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    assert rat.exact_percentiles(df, "v", shares) == pytest.approx(df.agg(F.percentile("v", shares)).first()[0])
    assert rat.exact_percentiles(df.limit(0), "v", [0.5]) == [None]


def test_attributes_of_pixels_without_a_row(spark):
    seg = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 7)], "row int, col int, seg_id bigint")
    table = spark.createDataFrame([(0, 5), (1, 6)], "seg_id bigint, a bigint")
    got = {r["col"]: r["a"] for r in rat.pixel_attribute(seg, table, "a").collect()}
    assert got == {0: -9999, 1: 6, 2: -9999}
