import numpy as np
import pytest

from mosaique.functions import geo
from mosaique.operators import kernel, subset, tiling
from mosaique.operators import segmentation as sg
from mosaique.sources import raster
from mosaique.sources.raster import RasterError
from tests.grids import array, pixels, segments


def spans(size, tile, overlap):
    return tiling.Axis(size, tile, overlap).spans()


def test_grid_rule():
    assert spans(8000, 4096, 1024) == [(0, 8000)]
    assert spans(8192, 4096, 1024) == [(0, 4096), (3072, 5120)]
    assert spans(200, 64, 16) == [(0, 64), (48, 64), (96, 104)]
    with pytest.raises(RasterError):
        tiling.Axis(100, 10, 3)


def test_pixels_in_tiles(spark):
    img = pixels(spark, [list(range(50))] * 3)
    got = {(r["tcol"], r["col"]) for r in tiling.explode_tiles(img, 50, 3, 16, 4).collect()}
    assert got == {(i, c) for i, (a, n) in enumerate(spans(50, 16, 4)) for c in range(a, a + n)}


def voronoi(size, centres, margin):
    y, x = np.mgrid[:size, :size]
    d = np.stack([(y - a) ** 2 + (x - b) ** 2 for a, b in centres])
    out = d.argmin(axis=0) + 1
    out[:margin], out[-margin:], out[:, :margin], out[:, -margin:] = 0, 0, 0, 0
    return out


def test_stitched_voronoi_segments(spark):
    """True regions on 3 x 3 tiles come out whole, with one id each and nulls in place."""
    rng = np.random.default_rng(4)
    size, k = 60, 9
    truth = voronoi(size, rng.integers(5, size - 5, (k, 2)), 2)
    img = pixels(spark, truth * 100, (k - truth) * 100 * (truth > 0), null=0).withColumnRenamed("b2", "b2")
    img = img.selectExpr("row", "col", "b1", "CASE WHEN b1 IS NULL THEN NULL ELSE coalesce(b2, 0) END AS b2")
    centres = spark.createDataFrame([(i, i * 100.0, (k - i) * 100.0) for i in range(1, k + 1)], "cluster_id int, c1 double, c2 double")
    done = tiling.segment_tiled(img, size, size, 24, 8, min_size=3, max_diff=10, centres=centres)
    got = array(done.seg)
    assert ((got == 0) == (truth == 0)).all()
    for s in np.unique(got[got > 0]):  # a segment is of one region
        assert len(np.unique(truth[got == s])) == 1
    assert len(np.unique(got[got > 0])) == len(np.unique(kernel.clump(truth)[truth > 0]))
    ids = np.unique(got[got > 0])
    assert ids.tolist() == list(range(1, len(ids) + 1))
    simple = tiling.segment_tiled(img, size, size, 24, 8, min_size=3, max_diff=10, centres=centres, simple=True)
    assert len(np.unique(array(simple.seg))) > len(ids)


def test_left_link_wins(spark):
    """A segment that crosses both middles takes its name from the tile to the left."""
    tiles = tiling.tile_table(spark, 12, 12, 8, 4)
    assert tiles.count() == 1 or tiles.agg({"tcol": "max"}).first()[0] >= 0
    tiles = tiling.tile_table(spark, 20, 20, 8, 4)
    rows = [(i, j, r, c, 5 + 10 * (i == 0 and j == 0) + i + 2 * j) for i, j, x, y, w, h in tiling.grid(20, 20, 8, 4) for r in range(y, y + h) for c in range(x, x + w)]
    seg = spark.createDataFrame(rows, "tcol int, trow int, row int, col int, local_id bigint")
    links = {(r["tcol"], r["trow"]): (r["to_tcol"], r["to_trow"]) for r in tiling.overlap_links(seg, tiles, 4).collect()}
    assert links[(1, 1)] == (0, 1) and links[(0, 1)] == (0, 0) and (0, 0) not in links
    assert np.unique(array(tiling.stitch(seg, tiles, 4))).tolist() == [1]


def test_subset(spark):
    seg = segments(spark, [[9, 9, 4, 4], [9, 7, 7, 4], [0, 7, 7, 4]])
    table = spark.createDataFrame([(4, 4, 40), (7, 4, 70), (9, 3, 90)], "seg_id bigint, Histogram bigint, a bigint")
    got = subset.subset(seg, table, 1, 0, 3, 3, (4, 3), orig_id_column="orig")
    assert array(got.seg).tolist() == [[1, 2, 2], [3, 3, 2], [3, 3, 2]]
    rows = {r["seg_id"]: (r["Histogram"], r["a"], r["orig"]) for r in got.rat.collect()}
    assert rows == {1: (1, 90, 9), 2: (4, 40, 4), 3: (4, 70, 7)}
    mask = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2)], "row int, col int, m int")
    got = subset.subset(seg, table, 1, 1, 2, 2, mask=mask)
    assert {r["old_id"] for r in got.recode.collect()} == {7}  # one segment keeps its row
    assert got.rat.count() == 1
    # blocks come before rows
    ids = {r["old_id"]: r["seg_id"] for r in subset.first_seen(seg, block=2).collect()}
    assert ids == {9: 1, 7: 2, 4: 3}
    with pytest.raises(RasterError):
        subset.subset(seg, table, 2, 0, 3, 3, (4, 3))
    with pytest.raises(RasterError):
        subset.carry_rows(table.selectExpr("seg_id", "'x' AS name"), got.recode)


def test_windows_on_the_map():
    gt = [500.0, 10.0, 0.0, 900.0, 0.0, -10.0]
    assert geo.box_window(gt, 100, 100, 525, 885, 565, 855) == (2, 1, 5, 4)
    assert geo.box_window(gt, 100, 100, 500, 900, 1500, -100) == (0, 0, 100, 100)  # up to the edges
    assert geo.mask_window(gt, 100, 100, "p", [520.0, 10.0, 0.0, 880.0, 0.0, -10.0], 5, 6, "p") == (2, 2, 5, 6)
    with pytest.raises(RasterError):
        geo.mask_window(gt, 100, 100, "p", gt, 5, 6, "q")


def test_store(spark, tmp_path):
    img = pixels(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    raster.write(img, str(tmp_path / "r"), block=2)
    assert array(raster.read(spark, str(tmp_path / "r")), "b1").tolist() == [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    part = raster.read(spark, str(tmp_path / "r"), (1, 1, 2, 1), block=2)
    assert sorted(r["b1"] for r in part.collect()) == [5, 6]
    meta = raster.meta_of(spark, 3, 3, nodata=[0.0, 0.0])
    assert raster.common_nodata(meta) == 0.0
    with pytest.raises(RasterError):
        raster.common_nodata(raster.meta_of(spark, 3, 3, nodata=[0.0, 1.0]))
    with pytest.raises(RasterError):
        raster.check_aligned(meta, raster.meta_of(spark, 3, 4))


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in (7, 3, 3, 11)], "k bigint")
    assert {r["k"]: r["i"] for r in sg.dense_ids(df, "k", "i").collect()} == {3: 1, 7: 2, 11: 3}


def test_only_the_tiles_are_broadcast(spark):
    """Tables that grow with the raster are shuffled, however small their files are."""
    rows = [(i, j, r, c, 1 + i + 2 * j + r % 2) for i, j, x, y, w, h in tiling.grid(20, 20, 8, 4) for r in range(y, y + h) for c in range(x, x + w)]
    seg = spark.createDataFrame(rows, "tcol int, trow int, row int, col int, local_id bigint")
    tiles = tiling.tile_table(spark, 20, 20, 8, 4)
    plan = tiling.stitch(seg, tiles, 4)._jdf.queryExecution().executedPlan().toString()
    kinds = [(x.split("BroadcastHashJoin [")[1] if "BroadcastHashJoin" in x else "").split("]")[0] for x in plan.splitlines()]
    assert not [x for x in kinds if "local_id" in x or "key" in x or "root" in x]
    assert plan.count("SortMergeJoin") >= 3  # the chains' ends, their numbers and the pixels
