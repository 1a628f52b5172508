import numpy as np
import pytest

from mosaique.operators import cluster, kernel, neighbours, spatial
from mosaique.operators import segmentation as sg
from tests.grids import array, pixels, segments


def test_clump_connectivity_and_order(spark):
    value = [[1, 2, 0], [2, 1, 0], [0, 0, 1]]
    df = pixels(spark, value, null=0).withColumnRenamed("b1", "v")
    assert array(sg.clump(df, "v")).tolist() == [[1, 2, 0], [3, 4, 0], [0, 0, 5]]
    assert array(sg.clump(df, "v", four_connected=False)).tolist() == [[1, 2, 0], [2, 1, 0], [0, 0, 1]]
    assert kernel.clump(np.array(value), False).tolist() == [[1, 2, 0], [2, 1, 0], [0, 0, 1]]


def test_single_pixels(spark):
    # the single 3 touches null (0) and two larger segments at equal distance: the first in scan order wins
    seg = segments(spark, [[1, 1, 1], [0, 3, 1], [2, 2, 2]])
    img = pixels(spark, [[5, 5, 5], [9, 7, 5], [9, 9, 9]])
    out = array(sg.eliminate_single_pixels(seg, img))
    assert out.tolist() == [[1, 1, 1], [0, 1, 1], [2, 2, 2]]
    # a single surrounded by null stays, and one null pixel alone is no segment
    seg = segments(spark, [[1, 0], [0, 0]])
    assert array(sg.eliminate_single_pixels(seg, pixels(spark, [[1, 1], [1, 1]]))).tolist() == [[1, 0], [0, 0]]
    # a single whose only neighbours are singles joins in the second round
    seg = segments(spark, [[1, 2, 3, 3]])
    assert array(sg.eliminate_single_pixels(seg, pixels(spark, [[1, 2, 3, 3]]))).tolist() == [[3, 3, 3, 3]]


def test_small_segments(spark):
    seg = segments(spark, [[1, 1, 2, 2, 2]])
    img = pixels(spark, [[0, 0, 9, 9, 9]])
    assert array(sg.eliminate_small_segments(seg, img, 3, 10)).tolist() == [[2, 2, 2, 2, 2]]
    assert array(sg.eliminate_small_segments(seg, img, 3, 8)).tolist() == [[1, 1, 2, 2, 2]]  # too different
    assert array(sg.eliminate_small_segments(seg, img, 2, 10)).tolist() == [[1, 1, 2, 2, 2]]  # large enough


@pytest.mark.parametrize(("seed", "four"), [(0, True), (1, False)])
def test_same_as_the_tile_kernel(spark, seed, four):
    rng = np.random.default_rng(seed)
    bands = rng.integers(0, 6, (2, 9, 11)) * 3
    valid = rng.random((9, 11)) > 0.1
    data = [np.where(valid, b, -1) for b in bands]
    img = pixels(spark, *data, null=-1)
    centres = [(1, [0.0, 3.0]), (2, [6.0, 9.0]), (3, [12.0, 12.0])]
    frame = spark.createDataFrame([(i, *c) for i, c in centres], "cluster_id int, c1 double, c2 double")
    done = sg.segment(img, min_size=6, max_diff=40, four_connected=four, centres=frame)
    want = kernel.segment(np.where(valid, bands, 0), valid, np.array([c for _, c in centres]), 6, 40, four)
    assert array(done.seg).tolist() == want.tolist()
    assert (array(done.seg) == 0).tolist() == (~valid).tolist()
    ids = np.unique(array(done.seg))
    assert ids[ids > 0].tolist() == list(range(1, len(ids[ids > 0]) + 1))
    again = sg.relabel(done.seg)
    assert array(again).tolist() == want.tolist()


def test_clusters(spark):
    img = pixels(spark, [[0, 10, 20, 99]], [[0, 10, 20, 5]], null=99)
    centres = cluster.diagonal_centres(img.dropna(), 3)
    assert [tuple(r) for r in centres.orderBy("cluster_id").collect()] == [(1, 5.0, 5.0), (2, 10.0, 10.0), (3, 15.0, 15.0)]
    own = cluster.assign(img, centres)
    assert array(own, "cluster_id").tolist() == [[1, 2, 3, 0]]
    fitted = cluster.fit(img, 3, 100, fixed_init=True)
    assert [r["c1"] for r in fitted.orderBy("cluster_id").collect()] == [0.0, 10.0, 20.0]
    assert cluster.max_difference(centres, None) == pytest.approx(10 * 200**0.5)
    assert cluster.max_difference(centres, 3) == 3
    assert cluster.max_difference(centres, "auto", 50) == pytest.approx(50**0.5)
    assert cluster.auto_proportion(100) == (1.0, 100.0)


def test_variogram_and_edges(spark):
    img = pixels(spark, [[1, 2, 4], [3, 5, 9], [1, 1, 1]])
    valued = img.selectExpr("row", "col", "b1", "1L AS seg_id")
    got = neighbours.variogram(valued, 3).first()
    diag = [(1, 5), (2, 9), (3, 1), (5, 1)]  # to the lower right; the other diagonal does not count
    assert got["variogram1"] == pytest.approx((sum((a - b) ** 2 for a, b in diag) / len(diag)) ** 0.5)
    assert got["variogram3"] == -9999
    again = spatial.spatial_stats(valued, [(f"v{i}", "float") for i in (1, 2, 3)], "variogram", 3).first()
    assert again["v1"] == pytest.approx(got["variogram1"], rel=1e-6) and again["v2"] == pytest.approx(got["variogram2"], rel=1e-6)
    # with the upper-right corner missing the middle has a gap among its eight neighbours, not among its four
    valid = valued.where("NOT (row = 0 AND col = 2)")
    assert neighbours.edge_pixel_counts(valid).first()["n_edge"] == 7
    assert neighbours.edge_pixel_counts(valid, False).first()["n_edge"] == 8
    for four, n in ((True, 7), (False, 8)):
        assert spatial.spatial_stats(valid, [("n", "int")], "num_edge_pixels", four).first()["n"] == n


def test_user_function_is_not_called_without_points(spark):
    valued = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 1, None), (2, 1, 0, None)], "seg_id bigint, row int, col int, b1 bigint")
    out = spatial.spatial_stats(valued, [("n", "int"), ("m", "float")], lambda pts, p: (len(pts), pts["val"].mean() + p), 1)
    assert {r["seg_id"]: (r["n"], r["m"]) for r in out.collect()} == {1: (1, 4.0), 2: (-9999, -9999.0)}


def test_user_functions_by_name_take_many_segments_at_once(spark):
    """The forms for many segments give what the functions give one by one, and segments may span Arrow batches."""
    rng = np.random.default_rng(7)
    seg = rng.integers(1, 6, (12, 10)) + 5 * (np.arange(12)[:, None] // 6)
    img = pixels(spark, np.where(rng.random((12, 10)) < 0.1, -1, rng.integers(0, 99, (12, 10))), null=-1)
    valued = img.join(segments(spark, seg), ["row", "col"])
    gt = [10.0, 3.0, 0.5, 7.0, 0.25, -3.0]
    cases = [("mean_coord", gt, "float", 2), ("num_edge_pixels", False, "int", 1), ("num_edge_pixels", True, "int", 1), ("variogram", 3, "float", 3)]
    for name, param, kind, n in cases:
        assert name in spatial.BATCHED
        columns = [(f"v{i}", kind) for i in range(n)]
        one = lambda pts, p, f=spatial.REGISTRY[name]: f(pts, p)
        want = {tuple(r) for r in spatial.spatial_stats(valued, columns, one, param).collect()}
        for rows in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            try:
                assert {tuple(r) for r in spatial.spatial_stats(valued, columns, name, param).collect()} == want
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = "seg_id bigint, row int, col int, b1 bigint"
    none = spark.createDataFrame([(3, 0, 0, None), (4, 0, 1, None), (4, 1, 1, 5)], frame)
    assert {tuple(r) for r in spatial.spatial_stats(none, [("n", "int")], "num_edge_pixels", True).collect()} == {(3, -9999), (4, 1)}
    assert spatial.spatial_stats(none.where("seg_id > 9"), [("n", "int")], "num_edge_pixels", True).count() == 0


def _rows_written(monkeypatch, spark):
    """A list that gets the number of rows of each table written between steps."""
    from mosaique.operators import graph

    rows, write = [], graph.cut

    def counted(df):
        out = write(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    monkeypatch.setattr(sg, "cut", counted)
    return rows


def test_rounds_of_single_pixels_do_not_rewrite_the_raster(spark, monkeypatch):
    grid = np.ones((12, 30), np.int64)
    grid[1], grid[0] = 0, np.arange(2, 32)
    grid[0, 26:] = 99  # singles 2..27 in a chain, each joined in a round of its own
    rows = _rows_written(monkeypatch, spark)
    out = array(sg.eliminate_single_pixels(segments(spark, grid), pixels(spark, np.arange(360).reshape(12, 30))))
    assert (out[0] == 99).all() and (out[1] == 0).all() and (out[2:] == 1).all()
    assert sum(rows) < 6 * grid.size  # was 27 rasters


def test_passes_of_small_segments_do_not_rewrite_the_graph(spark, monkeypatch):
    # a chain of single segments, one of which can merge in each pass, beside two hundred large ones
    grid = np.repeat(np.repeat(np.arange(100, 300).reshape(8, 25), 3, 0), 3, 1)
    grid[0, :6] = [1, 2, 3, 4, 5, 6]
    value = np.full(grid.shape, 50)
    value[0, :6] = 0
    value[:3, 6:9] = 0
    value[1] = np.where(np.arange(grid.shape[1]) < 6, 900, value[1])
    rows = _rows_written(monkeypatch, spark)
    seg, img = segments(spark, grid), pixels(spark, value)
    got = array(sg.eliminate_small_segments(seg, img, 2, 30))
    want = kernel.merge_small(grid, value[None], 2, 30)
    assert got.tolist() == want.tolist() and (got[0, :6] == 102).all()
    assert sum(rows) < 2 * grid.size
