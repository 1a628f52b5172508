"""Command lines: ``python -m mosaique.cli run-seg|tiling|stats|subset|variograms``.

Rasters are Parquet folders of :func:`mosaique.sources.raster.write`, or ENVI
files. A segmentation is written as ``OUT/seg``, ``OUT/rat`` and ``OUT/centres``,
with overviews, where asked for, as ``OUT/overviews/LEVEL``. Metadata (size,
transform, projection) go along where the input has them: rasters put together
must then be on one grid, and windows may be given in map coordinates.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaique.functions import geo
from mosaique.functions.stats import MISSING
from mosaique.functions.timers import Timers, report
from mosaique.operators import cluster, neighbours, rat, segmentation, subset, tiling, zonal
from mosaique.sources import envi, raster

STATS = ["min", "max", "mean", "stddev", "median", "mode", "pixcount"]


def _difference(text: str) -> str | float | None:
    return {"auto": "auto", "none": None}.get(text.lower()) if text.lower() in ("auto", "none") else float(text)


ENVI = (".img", ".bsq", ".bil", ".bip", ".raw", ".dat")


def metadata(spark: SparkSession, path: str) -> DataFrame | None:
    return envi.meta(spark, path) if path.endswith(ENVI) else raster.read_meta(spark, path)


def check_grids(seg_meta: DataFrame | None, img_meta: DataFrame | None) -> None:
    if seg_meta is not None and img_meta is not None:
        raster.check_aligned(seg_meta, img_meta)


def load(spark: SparkSession, path: str, bands: str | None = None, nodata: int | None = None) -> DataFrame:
    """A raster with the chosen bands and no-data as NULL."""
    if path.endswith(ENVI):
        envi.register(spark)
        pixels = spark.read.format("envi").load(path)
    else:
        pixels = raster.read(spark, path)
    if bands:
        pixels = raster.select_bands(pixels, [int(b) for b in bands.split(",")])
    raster.check_integer(pixels, raster.bands_of(pixels))
    return raster.with_nodata(pixels, nodata)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mosaique")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, segments: bool) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("-i", "--infile", required=True)
        p.add_argument("-o", "--outfile", required=True)
        if segments:
            p.add_argument("-n", "--nclusters", type=int, default=60)
            p.add_argument("--minsegmentsize", type=int, default=100)
            p.add_argument("--maxspectraldiff", type=_difference, default="auto")
            p.add_argument("--spectdistpcntile", type=float, default=50)
            p.add_argument("-b", "--bands", default="3,4,5")
            p.add_argument("--nullval", type=int, help="the no-data value; that of the metadata where not given")
            p.add_argument("--overviews", action="store_true")
            p.add_argument("--eightway", action="store_true")
            p.add_argument("--fixedkmeansinit", action="store_true")
            p.add_argument("--colours", action="store_true", help="random colours in the attribute table")
        return p

    p = command("run-seg", segments=True)
    p.add_argument("--clustersubsamplepercent", type=float, default=0.5)
    p = command("tiling", segments=True)
    p.add_argument("--clustersubsamplepercent", type=float)
    p.add_argument("-t", "--tilesize", type=int, default=tiling.TILE)
    p.add_argument("--overlapsize", type=int, default=tiling.OVERLAP)
    p.add_argument("--simplerecode", action="store_true")
    p = command("stats", segments=False)
    p.add_argument("--segfile", required=True)
    p.add_argument("--bands", default="1")
    p.add_argument("--stats", default='["mean", "stddev"]', help='JSON list of names or ["percentile", p]')
    p.add_argument("--colourbands", help="three bands whose means become colours")
    p = command("subset", segments=False)
    p.add_argument("--srcwin", type=int, nargs=4, metavar=("XOFF", "YOFF", "XSIZE", "YSIZE"))
    p.add_argument("--projwin", type=float, nargs=4, metavar=("ULX", "ULY", "LRX", "LRY"))
    p.add_argument("--mask")
    p.add_argument("--origsegidcol")
    p = command("variograms", segments=False)
    p.add_argument("--segfile", required=True)
    p.add_argument("-n", "--nvariograms", type=int, default=1, choices=range(1, 10))
    return top


def _write(spark: SparkSession, done: segmentation.Segmentation, out: str, colours: bool, overviews: bool, meta: DataFrame | None) -> None:
    raster.write(done.seg, f"{out}/seg")
    size = done.seg.agg(F.max("col") + 1, F.max("row") + 1).first()
    if meta is not None:
        m = meta.first()
        md = dict(m["md"] or {}) | {"centres": cluster.centres_json(done.centres).first()["json"]}
        raster.write_meta(raster.meta_of(spark, m["xsize"], m["ysize"], m["proj"], list(m["gt"]), [0.0], md), f"{out}/seg")
        size = m["xsize"], m["ysize"]
    if overviews:
        for level in rat.fixed_levels(*size):
            raster.write(rat.overview(done.seg, level), f"{out}/overviews/{level}")
    table = done.sizes.select("seg_id", F.col("n").alias(zonal.HISTOGRAM))
    if colours:
        table = rat.add_columns(table, rat.random_colours(table))
    table.write.parquet(f"{out}/rat")
    done.centres.write.parquet(f"{out}/centres")


def _subset_window(spark: SparkSession, args: argparse.Namespace, m, size) -> tuple[int, int, int, int]:
    """The window in pixels: as given, that of a box in map coordinates, or the one that the mask covers."""
    if args.srcwin:
        return tuple(args.srcwin)
    if m is None:
        raise raster.RasterError("without metadata the window must be given in pixels")
    gt = list(m["gt"])
    if args.projwin:
        return geo.box_window(gt, *size, *args.projwin)
    mask = metadata(spark, args.mask) if args.mask else None
    if mask is None:
        raise raster.RasterError("a window, a box or a mask with metadata is needed")
    k = mask.first()
    return geo.mask_window(gt, *size, m["proj"], list(k["gt"]), k["xsize"], k["ysize"], k["proj"])


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    timers = Timers()
    with timers.interval("walltime"):
        if args.command in ("run-seg", "tiling"):
            meta, nodata = metadata(spark, args.infile), args.nullval
            if meta is not None and nodata is None and meta.first()["nodata"]:
                nodata = raster.common_nodata(meta, [int(b) for b in args.bands.split(",")])
            pixels = load(spark, args.infile, args.bands, None if nodata is None else int(nodata))
            common = {
                "min_size": args.minsegmentsize, "clusters": args.nclusters, "max_diff": args.maxspectraldiff,
                "sample_percent": args.clustersubsamplepercent, "four_connected": not args.eightway,
                "fixed_init": args.fixedkmeansinit, "percentile": args.spectdistpcntile,
            }
            with timers.interval("segmentation"):
                if args.command == "run-seg":
                    done = segmentation.segment(pixels, **common)
                else:
                    size = pixels.agg(F.max("col") + 1, F.max("row") + 1).first()
                    done = tiling.segment_tiled(
                        pixels, *size, tile=args.tilesize, overlap=args.overlapsize, simple=args.simplerecode, **common
                    )
            with timers.interval("writing"):
                _write(spark, done, args.outfile, args.colours, args.overviews, meta)
        elif args.command == "stats":
            table = spark.read.parquet(f"{args.segfile}/rat")
            specs = [s if isinstance(s, str) else tuple(s) for s in json.loads(args.stats)]
            want = zonal.named_stats([int(b) for b in args.bands.split(",")], specs)
            check_grids(raster.read_meta(spark, f"{args.segfile}/seg"), metadata(spark, args.infile))
            both = zonal.overlay(raster.read_segments(spark, f"{args.segfile}/seg"), load(spark, args.infile))
            table = zonal.add_to_table(table, zonal.zonal_stats(both, want), want)
            if args.colourbands:
                names = [f"Band_{b}_mean" for b in args.colourbands.split(",")]
                table = rat.add_columns(table, rat.stretched_colours(table, *names))
            table.write.parquet(args.outfile)
        elif args.command == "subset":
            mask = load(spark, args.mask).select("row", "col", F.col("b1").cast("int").alias("m")) if args.mask else None
            seg, meta = raster.read_segments(spark, f"{args.infile}/seg"), raster.read_meta(spark, f"{args.infile}/seg")
            m = meta.first() if meta is not None else None
            size = (m["xsize"], m["ysize"]) if m else seg.agg(F.max("col") + 1, F.max("row") + 1).first()
            x, y, w, h = _subset_window(spark, args, m, size)
            got = subset.subset(
                seg, spark.read.parquet(f"{args.infile}/rat"), x, y, w, h, tuple(size), mask, args.origsegidcol
            )
            raster.write(got.seg, f"{args.outfile}/seg")
            if m:
                moved = raster.meta_of(spark, w, h, m["proj"], geo.shifted(list(m["gt"]), x, y), list(m["nodata"]), dict(m["md"]))
                raster.write_meta(moved, f"{args.outfile}/seg")
            got.rat.write.parquet(f"{args.outfile}/rat")
        else:
            check_grids(raster.read_meta(spark, f"{args.segfile}/seg"), metadata(spark, args.infile))
            both = zonal.overlay(raster.read_segments(spark, f"{args.segfile}/seg"), load(spark, args.infile))
            found = neighbours.variogram(both, args.nvariograms)
            table = rat.add_columns(spark.read.parquet(f"{args.segfile}/rat"), found)
            table.fillna({c: float(MISSING) for c in found.columns if c != "seg_id"}).write.parquet(args.outfile)
    print(report(rat.timing_summary(timers.table(spark)).collect()))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("mosaique").getOrCreate(), args)


if __name__ == "__main__":
    main()
