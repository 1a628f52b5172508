import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaique import cli
from mosaique.functions.timers import Timers, report
from mosaique.operators import rat
from mosaique.sources import envi, raster
from mosaique.streaming import completion
from tests.grids import array, pixels


def save(path, data, interleave, dtype, order=0):
    n, h, w = data.shape
    axes = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]
    code = {"u1": 1, "i2": 2, "u2": 12, "i4": 3}[dtype]
    path.write_bytes(b"head" + data.transpose(axes).astype((">" if order else "<") + dtype).tobytes())
    path.with_suffix(".hdr").write_text(
        f"ENVI\ndescription = {{a\n b}}\nsamples = {w}\nlines = {h}\nbands = {n}\nheader offset = 4\ndata type = {code}\n"
        f"interleave = {interleave}\nbyte order = {order}\ndata ignore value = 0\n"
    )


@pytest.mark.parametrize(("interleave", "dtype", "order"), [("bsq", "u2", 0), ("bil", "i2", 1), ("bip", "u1", 0)])
def test_envi(spark, tmp_path, monkeypatch, interleave, dtype, order):
    data = np.arange(2 * 5 * 7).reshape(2, 5, 7)
    save(tmp_path / "x.img", data, interleave, dtype, order)
    envi.register(spark)
    df = spark.read.format("envi").load(str(tmp_path / "x.img"))
    assert df.where("b1 IS NULL").count() == 1  # the value 0
    got = df.fillna(0)
    assert array(got, "b1").tolist() == data[0].tolist() and array(got, "b2").tolist() == data[1].tolist()
    reader = envi.EnviReader(str(tmp_path / "x.img"), envi.Layout(envi.parse_header((tmp_path / "x.hdr").read_text())))
    monkeypatch.setattr(envi, "PIXELS", 14)
    parts = reader.partitions()
    assert [(p.first, p.count) for p in parts] == [(0, 2), (2, 2), (4, 1)]
    assert [b["b2"].to_pylist() for p in parts[1:2] for b in reader.read(p)] == [data[1, 2:4].ravel().tolist()]


def test_command_lines(spark, tmp_path):
    truth = np.kron([[1, 2], [3, 4]], np.ones((6, 6), int)) * 50
    raster.write(pixels(spark, truth, truth * 2), str(tmp_path / "img"))

    def call(*argv):
        cli.run(spark, cli.parser().parse_args([*map(str, argv)]))

    common = ["-i", tmp_path / "img", "--bands", "1,2", "--nclusters", 4, "--minsegmentsize", 3, "--fixedkmeansinit", "--clustersubsamplepercent", 100]
    call("run-seg", *common, "-o", tmp_path / "a", "--colours")
    call("tiling", *common, "-o", tmp_path / "b", "--tilesize", 8, "--overlapsize", 4)
    a, b = (array(raster.read_segments(spark, str(tmp_path / x / "seg"))) for x in "ab")
    assert len(np.unique(a)) == len(np.unique(b)) == 4
    call("stats", "-i", tmp_path / "img", "-o", tmp_path / "s", "--segfile", tmp_path / "a", "--bands", "1,2",
         "--stats", '["mean", ["percentile", 20]]', "--colourbands", "1,2,1")
    table = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["Band_1_mean"] for r in table.collect()) == [50, 100, 150, 200]
    assert {"Band_2_pcnt20", "Histogram", "Red", "Alpha"} <= set(table.columns)
    call("variograms", "-i", tmp_path / "img", "-o", tmp_path / "v", "--segfile", tmp_path / "a", "-n", 2)
    assert {r["variogram1"] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {0.0}
    call("subset", "-i", tmp_path / "a", "-o", tmp_path / "c", "--srcwin", 3, 0, 4, 3, "--origsegidcol", "orig")
    assert array(raster.read_segments(spark, str(tmp_path / "c" / "seg"))).tolist() == [[1, 1, 1, 2]] * 3


def test_segments_are_emitted_as_they_complete(spark, tmp_path):
    rows = [(1, 3, 5), (2, 1, 7), (1, 3, None), (3, 2, 1), (1, 3, 9)]
    df = spark.createDataFrame(rows, "seg_id bigint, expected bigint, value bigint")
    for i, part in enumerate(([0, 1], [2, 3], [4])):
        df.limit(5).where(F.lit(True)).sparkSession.createDataFrame([rows[k] for k in part], df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = completion.completed_segments(stream).writeStream.format("memory").queryName("done").outputMode("append")
    q = query.option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["seg_id"]: (r["n"], r["valid"], r["total"], r["low"], r["high"]) for r in spark.table("done").collect()}
    assert got == {1: (3, 2, 14, 5, 9), 2: (1, 1, 7, 7, 7)}  # 3 is not complete


def test_timers(spark):
    t, u = Timers(), Timers()
    with t.interval("a"), u.interval("a"), u.interval("b"):
        pass
    t.merge(u)
    assert len(t.durations("a")) == 2 and t.durations("c") == []
    rows = rat.timing_summary(t.table(spark)).collect()
    assert {r["name"]: r["count"] for r in rows} == {"a": 2, "b": 1}
    assert "a" in report(rows)
