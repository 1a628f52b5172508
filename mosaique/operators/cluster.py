"""Spectral clustering: sampling, k-means, nearest centres and the distance threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaique.operators.graph import cut
from mosaique.sources.raster import bands_of

#: Pixels that the whole-file fit aims to sample.
SAMPLE_PIXELS = 1_000_000


def systematic_sample(pixels: DataFrame, percent: float) -> DataFrame:
    """Every round(100/percent)-th non-null pixel in scan order.

    Ranks come from counts per row and a position within each row, so no task
    orders more than a row of the raster.
    """
    skip = max(1, round(100 / percent))
    valid = pixels.dropna(how="any", subset=bands_of(pixels))
    if skip == 1:
        return valid
    per_row = valid.groupBy("row").agg(F.count("*").alias("k"))
    # one row per row of the raster
    before = Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_row.select("row", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy("col"))
    return (
        valid.join(starts, "row")
        .withColumn("_rank", F.col("base") + rank - 1)
        .where(F.col("_rank") % skip == 0)
        .select(*pixels.columns)
    )


def auto_proportion(n_pixels: int) -> tuple[float, float]:
    """(share of rows and columns, percentage of pixels) that samples about SAMPLE_PIXELS."""
    prop = min(1.0, (SAMPLE_PIXELS / max(1, n_pixels)) ** 0.5)
    return prop, 100 * prop * prop


def diagonal_centres(sample: DataFrame, k: int) -> DataFrame:
    """(cluster_id, c1..) at k points of the diagonal of the sample's box, cut to integers."""
    bands = bands_of(sample)
    box = sample.agg(*[f(b).alias(f"{n}{b}") for b in bands for n, f in (("lo_", F.min), ("hi_", F.max))])
    steps = box.withColumn("cluster_id", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return steps.select(
        "cluster_id",
        *[
            (F.col(f"lo_{b}") + F.col("cluster_id") * (F.col(f"hi_{b}") - F.col(f"lo_{b}")) / F.lit(k + 1))
            .cast("bigint")
            .cast("double")
            .alias(f"c{i}")
            for i, b in enumerate(bands, 1)
        ],
    )


def centre_rows(centres: DataFrame) -> list[tuple[int, list[float]]]:
    """Centres on the driver: as many rows as clusters."""
    rows = centres.orderBy("cluster_id").collect()
    return [(r["cluster_id"], [float(r[c]) for c in centres.columns if c != "cluster_id"]) for r in rows]


def nearest(bands: Sequence[Column], centres: list[tuple[int, list[float]]]) -> Column:
    """The id of the nearest centre, the lowest of equals, as one expression over the bands."""
    found = []
    for i, c in centres:
        d = F.lit(0.0)
        for b, x in zip(bands, c):
            d = d + (b - F.lit(x)) * (b - F.lit(x))
        found.append(F.struct(d.alias("d"), F.lit(i).alias("id")))
    return (F.least(*found) if len(found) > 1 else found[0])["id"]


def assign(pixels: DataFrame, centres: DataFrame | list[tuple[int, list[float]]]) -> DataFrame:
    """``pixels`` with ``cluster_id``: the nearest centre, 0 where any band is null.

    The centres, one row per cluster, become literals of a projection; there is no join.
    """
    rows = centres if isinstance(centres, list) else centre_rows(centres)
    bands = bands_of(pixels)
    null = F.lit(False)
    for b in bands:
        null = null | F.col(b).isNull()
    return pixels.withColumn("cluster_id", F.when(null, F.lit(0)).otherwise(nearest([F.col(b) for b in bands], rows)))


def lloyd(sample: DataFrame, centres: DataFrame, rounds: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """K-means from given centres; a centre without pixels stays where it is.

    Each round is an aggregation with the centres as literals; a row for each centre comes back.
    """
    rows = centre_rows(centres)
    bands = bands_of(sample)
    points = sample.select(*[F.col(b).cast("double").alias(b) for b in bands]).persist()
    columns = [F.col(b) for b in bands]
    try:
        for _ in range(rounds):
            sums = points.groupBy(nearest(columns, rows).alias("cluster_id")).agg(*[F.avg(b).alias(b) for b in bands])
            found = {r["cluster_id"]: [r[b] for b in bands] for r in sums.collect()}
            new = [(i, found.get(i, c)) for i, c in rows]
            moved = max(sum((x - y) ** 2 for x, y in zip(a, b)) for (_, a), (_, b) in zip(rows, new))
            rows = new
            if moved <= tolerance * tolerance:
                break
    finally:
        points.unpersist()
    return _centre_table(sample, [c for _, c in rows], [i for i, _ in rows])


def _centre_table(sample: DataFrame, centres: Sequence[Sequence[float]], ids: Sequence[int] | None = None) -> DataFrame:
    schema = "cluster_id int, " + ", ".join(f"c{i} double" for i in range(1, len(bands_of(sample)) + 1))
    rows = [(i, *map(float, c)) for i, c in zip(ids or range(1, len(centres) + 1), centres)]
    return sample.sparkSession.createDataFrame(rows, schema)


def fit(
    pixels: DataFrame, k: int = 60, percent: float = 1, fixed_init: bool = False, seed: int = 42, starts: int = 5
) -> DataFrame:
    """Cluster centres (cluster_id from 1, c1..) of a systematic sample of the non-null pixels.

    Without ``fixed_init`` the best of ``starts`` fits from different seeds, by the sum of squared distances.
    """
    bands = bands_of(pixels)
    sample = cut(systematic_sample(pixels, percent).select("row", "col", *bands))
    if fixed_init:
        return lloyd(sample, diagonal_centres(sample, k))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=bands, outputCol="features").transform(sample).select("features").persist()
    try:
        fitted = [KMeans(k=k, seed=seed + i, initMode="k-means||").fit(vectors) for i in range(starts)]
        best = min(fitted, key=lambda m: m.summary.trainingCost)
    finally:
        vectors.unpersist()
    return _centre_table(sample, best.clusterCenters())


def centre_distances(centres: DataFrame) -> DataFrame:
    """(d): the distance of each pair of centres, as FLOAT precision gives it."""
    cs = [c for c in centres.columns if c != "cluster_id"]
    a, b = centres.alias("a"), centres.alias("b")
    d = F.lit(0.0)
    for c in cs:
        d = d + (F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}"))
    # pairs of clusters, both sides of a stated small size
    return a.join(F.broadcast(b), F.col("a.cluster_id") < F.col("b.cluster_id")).select(F.sqrt(d).alias("d"))


def max_difference(centres: DataFrame, given: str | float | None = "auto", percentile: float = 50) -> float:
    """The largest spectral distance at which small segments merge.

    ``auto`` interpolates a percentile of the centres' distances, None stands for
    ten times the largest of them and a number for itself.
    """
    if given is not None and given != "auto":
        return float(given)
    found = centre_distances(centres).agg(
        F.percentile("d", percentile / 100).alias("p"), F.max("d").alias("top")
    ).first()
    value = found["p"] if given == "auto" else found["top"] and 10 * found["top"]
    return float(value or 0.0)


def centres_json(centres: DataFrame) -> DataFrame:
    """(json): the centres as a JSON list of lists, for a raster's metadata."""
    cs = [c for c in centres.columns if c != "cluster_id"]
    rows = F.array_sort(F.collect_list(F.struct("cluster_id", F.array(*cs).alias("c"))))
    return centres.agg(F.to_json(F.transform(rows, lambda x: x["c"])).alias("json"))
