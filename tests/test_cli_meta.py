import numpy as np
import pytest

from mosaique import cli
from mosaique.sources import raster
from mosaique.streaming.completion import check_complete
from tests.grids import array, pixels

GT = [500.0, 10.0, 0.0, 900.0, 0.0, -10.0]


def test_metadata_go_along(spark, tmp_path):
    truth = np.kron([[1, 2], [3, 4]], np.ones((6, 6), int)) * 50
    raster.write(pixels(spark, truth), str(tmp_path / "img"))
    raster.write_meta(raster.meta_of(spark, 12, 12, "p", GT, [65535.0]), str(tmp_path / "img"))
    mask = np.ones((3, 4), int)
    mask[0, 0] = 0
    raster.write(pixels(spark, mask), str(tmp_path / "mask"))
    raster.write_meta(raster.meta_of(spark, 4, 3, "p", [530.0, 10.0, 0.0, 880.0, 0.0, -10.0]), str(tmp_path / "mask"))

    def call(*argv):
        cli.run(spark, cli.parser().parse_args([*map(str, argv)]))

    call("run-seg", "-i", tmp_path / "img", "-o", tmp_path / "a", "--bands", "1", "--nclusters", 4, "--minsegmentsize", 3,
         "--fixedkmeansinit", "--clustersubsamplepercent", 100, "--overviews")
    seg = str(tmp_path / "a" / "seg")
    m = raster.read_meta(spark, seg).first()
    assert (m["xsize"], m["ysize"], m["proj"], m["gt"]) == (12, 12, "p", GT) and m["md"]["centres"].startswith("[[")
    assert raster.read_segments(spark, seg).count() == 144
    call("subset", "-i", tmp_path / "a", "-o", tmp_path / "b", "--projwin", 530, 880, 570, 850)
    got = array(raster.read_segments(spark, str(tmp_path / "b" / "seg")))
    assert got.shape == (3, 4) and len(np.unique(got)) == 2
    assert raster.read_meta(spark, str(tmp_path / "b" / "seg")).first()["gt"] == [530.0, 10.0, 0.0, 880.0, 0.0, -10.0]
    call("subset", "-i", tmp_path / "a", "-o", tmp_path / "c", "--mask", tmp_path / "mask")
    masked = array(raster.read_segments(spark, str(tmp_path / "c" / "seg")))
    assert masked[0, 0] == 0 and masked[0, 1:].tolist() == got[0, 1:].tolist() and masked[1:].tolist() == got[1:].tolist()
    raster.write(pixels(spark, truth), str(tmp_path / "other"))
    raster.write_meta(raster.meta_of(spark, 12, 12, "q", GT), str(tmp_path / "other"))
    with pytest.raises(raster.RasterError, match="proj"):
        call("stats", "-i", tmp_path / "other", "-o", tmp_path / "s", "--segfile", tmp_path / "a", "--stats", '["mean"]')


def test_incomplete_segments_are_an_error(spark):
    done = spark.createDataFrame([(1, 3)], "seg_id bigint, n bigint")
    sizes = spark.createDataFrame([(0, 5), (1, 3)], "seg_id bigint, expected bigint")
    check_complete(done, sizes)
    with pytest.raises(raster.RasterError, match="1 segments are incomplete: 2"):
        check_complete(done, sizes.union(spark.createDataFrame([(2, 1)], sizes.schema)))
