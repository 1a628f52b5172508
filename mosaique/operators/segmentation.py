"""Segmentation of a whole raster with joins and aggregations.

clump -> single pixels -> small segments -> relabel. Merging works on the graph
of segments (sizes, exact sums, adjacency); pixels are re-pointed once at the
end. Ties go to the lowest neighbour id (segments) or first in scan order
(pixels). Null pixels are segment 0, which merges with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaique.operators import cluster as km
from mosaique.operators.graph import components, cut, cut_wide, drop_cut
from mosaique.operators.neighbours import adjacent_segments, offsets, squared_distance
from mosaique.operators.zonal import segment_sizes, spectral_sums
from mosaique.sources.raster import bands_of

#: Merge passes over the segments of one size at most.
PASSES = 10

#: So many moves of a pass at most are broadcast to the pairs; more are joined by shuffle.
FEW = 20_000


def dense_ids(keys: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): 1.. in the order of distinct keys, without ordering them all in one task.

    Keys are range-partitioned; ids are a partition's offset plus the rank within it.
    """
    parts = cut(
        keys.select(key).distinct().repartitionByRange(key).select(key, F.spark_partition_id().alias("_part"))
    )
    counts = parts.groupBy("_part").agg(F.count("*").alias("_k"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as partitions
    offsets = counts.select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return parts.join(F.broadcast(offsets), "_part").select(key, (F.col("_base") + rank).alias(out))


def _with_runs(known: DataFrame) -> DataFrame:
    """``known`` (row, col, v, at) with ``run``: the place of the first pixel of its horizontal run of equal values."""
    line = Window.partitionBy("row").orderBy("col")
    begins = ~((F.lag("col").over(line) == F.col("col") - 1) & (F.lag("v").over(line) == F.col("v")))
    marked = known.withColumn("_first", F.when(F.coalesce(begins, F.lit(True)), F.col("at")))
    return marked.withColumn("run", F.last("_first", ignorenulls=True).over(line)).drop("_first")


def _run_links(runs: DataFrame, four_connected: bool) -> DataFrame:
    """(u, v): runs that touch in neighbouring rows with equal values; each direction is one ordered pass."""
    ways = [F.col("col")] if four_connected else [F.col("col"), F.col("col") - F.col("row"), F.col("col") + F.col("row")]
    out = None
    for way in ways:
        down = Window.partitionBy("_way").orderBy("row")
        told = runs.withColumn("_way", way).select(
            F.col("run").alias("u"),
            F.lead("run").over(down).alias("v"),
            ((F.lead("row").over(down) == F.col("row") + 1) & (F.lead("v").over(down) == F.col("v"))).alias("_same"),
        )
        links = told.where("_same").select("u", "v")
        out = links if out is None else out.unionByName(links)
    return out.distinct()


def clump(pixels: DataFrame, value: str = "cluster_id", four_connected: bool = True, first_id: int = 1) -> DataFrame:
    """(row, col, seg_id): components of equal ``value``, numbered in scan order of their first pixels; 0 where it is 0 or null.

    The graph is that of horizontal runs, not of pixels: runs come from one pass
    along the rows, their links from one pass along each direction that crosses
    rows, and a component's smallest run begins at its first pixel.
    """
    own = pixels.select("row", "col", F.col(value).alias("v"))
    own = own.withColumn("at", (F.col("row").cast("bigint") * F.lit(1 << 31)) + F.col("col"))
    runs = cut_wide(_with_runs(own.where("v IS NOT NULL AND v <> 0")))
    roots = components(_run_links(runs, four_connected))
    rooted = runs.join(roots, runs["run"] == roots["node"], "left").select(
        "row", "col", F.coalesce("root", "run").alias("root")
    )
    ids = dense_ids(rooted, "root", "seg_id")
    found = rooted.join(ids.hint("merge"), "root").select("row", "col", (F.col("seg_id") + first_id - 1).alias("seg_id"))
    rest = own.where("v IS NULL OR v = 0").select("row", "col", F.lit(0).cast("bigint").alias("seg_id"))
    return found.unionByName(rest)


def relabel(seg: DataFrame, first_id: int = 1) -> DataFrame:
    """Ids without gaps, in the same order; 0 stays."""
    ids = dense_ids(seg.where("seg_id <> 0"), "seg_id", "_new")
    return seg.join(ids.hint("merge"), "seg_id", "left").withColumn(
        "seg_id", F.coalesce(F.col("_new") + first_id - 1, F.lit(0)).cast("bigint")
    ).drop("_new")


def nearest_neighbour_pixels(seg: DataFrame, pixels: DataFrame, four_connected: bool = True) -> DataFrame:
    """(row, col, seg_id, target) of single pixels that touch a larger segment.

    The target holds the spectrally nearest neighbour, the first in scan order of equals.
    """
    bands = bands_of(pixels)
    sizes = segment_sizes(seg)
    single = sizes.where("n = 1").select("seg_id")
    own = seg.where("seg_id <> 0").join(pixels, ["row", "col"])
    alone = own.join(single, "seg_id")
    larger = own.join(single, "seg_id", "left_anti").select(*[F.col(c).alias(f"n_{c}") for c in own.columns])
    steps = neighbour_steps(alone, four_connected).join(larger, ["n_row", "n_col"])
    d2 = squared_distance([F.col(b) for b in bands], [F.col(f"n_{b}") for b in bands])
    best = F.min(F.struct(d2.alias("d2"), "n_row", "n_col", "n_seg_id"))
    return steps.groupBy("row", "col", "seg_id").agg(best.alias("best")).select(
        "row", "col", "seg_id", F.col("best.n_seg_id").alias("target")
    )


def neighbour_steps(pixels: DataFrame, four_connected: bool) -> DataFrame:
    """Each pixel with its neighbours' positions n_row and n_col."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets(four_connected)])
    return (
        pixels.withColumn("_o", F.explode(steps))
        .withColumns({"n_row": F.col("row") + F.col("_o.dr"), "n_col": F.col("col") + F.col("_o.dc")})
        .drop("_o")
    )


def merge_single_pixels(seg: DataFrame, pixels: DataFrame, four_connected: bool = True) -> DataFrame:
    """One round: every single pixel that touches a larger segment joins the nearest; all decide from one state."""
    moved = nearest_neighbour_pixels(seg, pixels, four_connected).select("row", "col", "target")
    return seg.join(moved, ["row", "col"], "left").select("row", "col", F.coalesce("target", "seg_id").alias("seg_id"))


def eliminate_single_pixels(seg: DataFrame, pixels: DataFrame, four_connected: bool = True) -> DataFrame:
    """Rounds until no single pixel merges; ids are not renumbered.

    Only single pixels move. After the first round those are left that touch
    singles alone, and what a round lets them join is what moved in the one before.
    """
    bands = bands_of(pixels)
    now = cut_wide(seg.select("row", "col", "seg_id"))
    own = now.where("seg_id <> 0")
    places = own.groupBy("seg_id").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("col").alias("col"))
    alone = places.where("n = 1").select("row", "col", F.lit(True).alias("alone")).hint("merge")
    known = own.join(pixels.select("row", "col", *bands), ["row", "col"]).join(alone, ["row", "col"], "left")
    known = cut_wide(known.withColumn("alone", F.coalesce("alone", F.lit(False))))
    other = known.select(*[F.col(c).alias(f"n_{c}") for c in known.columns])
    d2 = squared_distance([F.col(b) for b in bands], [F.col(f"n_{b}") for b in bands]).alias("d2")
    steps = neighbour_steps(known.where("alone").select("row", "col", *bands), four_connected)
    best = F.min(F.when(~F.col("n_alone"), F.struct(d2, "n_row", "n_col", "n_seg_id"))).alias("best")
    found = steps.join(other, ["n_row", "n_col"]).groupBy("row", "col").agg(best, *[F.min(b).alias(b) for b in bands])
    first = cut_wide(found.select("row", "col", F.col("best.n_seg_id").alias("target"), *bands))
    steps = neighbour_steps(first.where("target IS NULL").drop("target"), four_connected)
    pairs = steps.join(other.where("n_alone"), ["n_row", "n_col"]).select("row", "col", "n_row", "n_col", d2)
    pairs = cut_wide(pairs)
    moved = [first.where("target IS NOT NULL").select("row", "col", "target")]
    kept = [now, known, first]
    while True:
        last = moved[-1].select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), "target")
        best = F.min(F.struct("d2", "n_row", "n_col", "target")).alias("best")
        new = pairs.join(last, ["n_row", "n_col"]).groupBy("row", "col").agg(best)
        new = cut_wide(new.select("row", "col", F.col("best.target").alias("target")))
        kept.append(new)
        if not new.limit(1).count():
            break
        rest = cut_wide(pairs.join(new.select("row", "col"), ["row", "col"], "left_anti"))
        drop_cut(pairs)
        pairs = rest
        if len(moved) > 16:  # short plans in long chains of singles; the last round stays apart
            moved = [cut_wide(_union(moved))]
            kept.append(moved[0])
        moved.append(new)
    out = now.join(_union(moved).hint("merge"), ["row", "col"], "left")
    out = cut_wide(out.select("row", "col", F.coalesce("target", "seg_id").alias("seg_id")))
    for x in [*kept, pairs]:
        drop_cut(x)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def merge_targets(nodes: DataFrame, edges: DataFrame, size: int, max_diff: float) -> DataFrame:
    """(seg_id, target) for segments of ``size`` pixels: the touching larger segment with the nearest mean.

    ``nodes`` has seg_id, n and sums s1.., ``edges`` has a and b in both
    directions. The lowest id wins ties; none qualifies beyond ``max_diff``.
    """
    sums = [c for c in nodes.columns if c[:1] == "s" and c[1:].isdigit()]
    small = nodes.where(F.col("n") == size)
    large = nodes.where(F.col("n") > size).select(*[F.col(c).alias(f"n_{c}") for c in nodes.columns])
    mean = [F.col(s) / F.col("n") for s in sums]
    other = [F.col(f"n_{s}") / F.col("n_n") for s in sums]
    near = small.join(edges, small["seg_id"] == edges["a"]).join(large, edges["b"] == large["n_seg_id"])
    near = near.withColumn("d2", squared_distance(mean, other))
    best = near.groupBy("seg_id").agg(F.min(F.struct("d2", "n_seg_id")).alias("best"))
    return best.where(F.col("best.d2") <= F.lit(max_diff * max_diff)).select(
        "seg_id", F.col("best.n_seg_id").alias("target")
    )


def apply_merges(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the merges; a target is larger than what joins it, so none moves itself."""
    sums = [c for c in nodes.columns if c != "seg_id"]
    moved = nodes.join(targets, "seg_id", "left").withColumn("seg_id", F.coalesce("target", "seg_id"))
    nodes = moved.groupBy("seg_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])
    ta = targets.select(F.col("seg_id").alias("a"), F.col("target").alias("ta"))
    tb = targets.select(F.col("seg_id").alias("b"), F.col("target").alias("tb"))
    edges = (
        edges.join(ta, "a", "left")
        .join(tb, "b", "left")
        .select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    return nodes, edges


def eliminate_small_segments(
    seg: DataFrame, pixels: DataFrame, min_size: int, max_diff: float, four_connected: bool = True
) -> DataFrame:
    """Merge segments below ``min_size``, the smallest first; sizes that do not occur cost nothing.

    The edges of small segments are written once, with the ids that segments began with. A size takes its own
    edges from them, by what has become of both ends. What stays after a pass had no target near enough, so the
    next one looks only at pairs whose other end has grown or moved.
    """
    bands = bands_of(pixels)
    own = cut_wide(seg.select("row", "col", "seg_id"))
    nodes = cut_wide(spectral_sums(own.join(pixels.select("row", "col", *bands), ["row", "col"]), bands))
    small = nodes.where(F.col("n") < min_size).select(F.col("seg_id").alias("a"))
    edges = cut_wide(adjacent_segments(own, four_connected).join(small, "a", "left_semi"))
    mapping: DataFrame | None = None
    done = 0
    while True:
        sizes = {r["n"]: r["k"] for r in nodes.where((F.col("n") > done) & (F.col("n") < min_size)).groupBy("n").agg(F.count("*").alias("k")).collect()}
        if not sizes:
            break
        size = min(sizes)
        left = sizes[size]
        standing = [cut(_pairs(nodes, mapping, edges, size))]
        merged: list[DataFrame] = []
        for i in range(PASSES):
            moves = cut_wide(_moves(standing[-1], size, max_diff))
            n = moves.count()
            if not n:
                drop_cut(moves)
                break
            merged.append(moves)
            left -= n
            if not left or i == PASSES - 1:
                break
            standing.append(cut(_changed_pairs(standing, merged, size, n <= FEW)))
        for x in standing:
            drop_cut(x)
        if merged:
            nodes, mapping = _settled(nodes, mapping, merged, size)
        done = size
    drop_cut(edges)
    drop_cut(nodes)
    if mapping is None:
        return own
    out = own.join(mapping.withColumnRenamed("old", "seg_id"), "seg_id", "left")
    return out.select("row", "col", F.coalesce("new", "seg_id").alias("seg_id"))


def _sums(df: DataFrame, prefix: str = "s") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]


def _pairs(nodes: DataFrame, mapping: DataFrame | None, edges: DataFrame, size: int) -> DataFrame:
    """(seg_id, s1.., other, o_n, o_s1..): segments of ``size`` pixels with those they touch, as they are now.

    Smaller ones are left out: they neither merge any more nor are joined.
    """
    sums = _sums(nodes)
    ids = nodes.where(F.col("n") >= size).select(F.col("seg_id").alias("id"), *nodes.columns)
    if mapping is not None:
        became = mapping.select(F.col("old").alias("id"), F.col("new").alias("seg_id"))
        ids = ids.unionByName(became.join(nodes.where(F.col("n") >= size), "seg_id").select(*ids.columns))
    ends = ids.where(F.col("n") == size).select(F.col("id").alias("a"), "seg_id", *sums)
    others = ids.select(
        F.col("id").alias("b"), F.col("seg_id").alias("other"), F.col("n").alias("o_n"), *[F.col(c).alias(f"o_{c}") for c in sums]
    )
    both = edges.join(ends.hint("merge"), "a").join(others.hint("merge"), "b").where("seg_id <> other")
    return both.drop("a", "b")


def _moves(pairs: DataFrame, size: int, max_diff: float) -> DataFrame:
    """(seg_id, s1.., target, o_n, o_s1..): what :func:`merge_targets` finds, with the target as it was."""
    sums, theirs = _sums(pairs), _sums(pairs, "o_s")
    mean = [F.col(c) / F.lit(size) for c in sums]
    d2 = squared_distance(mean, [F.col(c) / F.col("o_n") for c in theirs])
    near = pairs.where(F.col("o_n") > size).withColumn("d2", d2).where(F.col("d2") <= F.lit(max_diff * max_diff))
    best = near.groupBy("seg_id").agg(
        F.min(F.struct("d2", "other", "o_n", *theirs)).alias("best"), *[F.min(c).alias(c) for c in sums]
    )
    return best.select("seg_id", *sums, F.col("best.other").alias("target"), "best.o_n", *[f"best.{c}" for c in theirs])


def _changed_pairs(standing: list[DataFrame], merged: list[DataFrame], size: int, few: bool) -> DataFrame:
    """Pairs of the segments that stay, of which the last moves have changed the other end.

    ``standing`` has the pairs at first and those of each pass; a pair may be there as it was and as it became.
    """
    moves = merged[-1]
    sums, theirs = _sums(moves), _sums(moves, "o_s")
    grown = moves.groupBy("target").agg(
        (F.min("o_n") + F.count("*") * size).alias("g_n"),
        *[(F.min(t) + F.sum(c)).cast("bigint").alias(f"g_{c}") for c, t in zip(sums, theirs)],
    )
    named = moves.select(F.col("seg_id").alias("other"), "target")
    named = named.unionByName(grown.select(F.col("target").alias("other"), "target"))
    news = named.join(grown.hint("merge"), "target")
    news = F.broadcast(news) if few else news.hint("merge")  # at most 2 * FEW rows
    gone = _union([m.select("seg_id") for m in merged]).hint("merge")
    pairs = _union([x.select("seg_id", *sums, "other") for x in standing]).join(news, "other")
    return pairs.join(gone, "seg_id", "left_anti").select(
        "seg_id", *sums, F.col("target").alias("other"), F.col("g_n").alias("o_n"),
        *[F.col(f"g_{c}").alias(t) for c, t in zip(sums, theirs)],
    ).distinct()


def _settled(nodes: DataFrame, mapping: DataFrame | None, merged: list[DataFrame], size: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and mapping (old, new) after the moves of one size; what a move joins does not move itself."""
    sums = _sums(nodes)
    moves = _union([m.select("seg_id", "target", *sums) for m in merged])
    gains = moves.groupBy(F.col("target").alias("seg_id")).agg(
        (F.count("*") * size).alias("g_n"), *[F.sum(c).cast("bigint").alias(f"g_{c}") for c in sums]
    )
    stay = nodes.join(moves.select("seg_id").hint("merge"), "seg_id", "left_anti").join(gains.hint("merge"), "seg_id", "left")
    after = [(F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in ("n", *sums)]
    new_nodes = cut_wide(stay.select("seg_id", *after))
    step = moves.select(F.col("seg_id").alias("old"), F.col("target").alias("new"))
    if mapping is not None:
        later = step.select(F.col("old").alias("new"), F.col("new").alias("now")).hint("merge")
        step = step.unionByName(mapping.join(later, "new", "left").select("old", F.coalesce("now", "new").alias("new")))
    new_mapping = cut_wide(step)
    for x in (nodes, mapping, *merged):
        if x is not None:
            drop_cut(x)
    return new_nodes, new_mapping


@dataclass
class Segmentation:
    """A finished segmentation: seg (row, col, seg_id), the centres and the distance used."""

    seg: DataFrame
    centres: DataFrame
    max_diff: float

    @property
    def sizes(self) -> DataFrame:
        return segment_sizes(self.seg)


def segment(
    pixels: DataFrame,
    clusters: int = 60,
    sample_percent: float = 1,
    min_size: int = 50,
    max_diff: str | float | None = "auto",
    four_connected: bool = True,
    fixed_init: bool = False,
    centres: DataFrame | None = None,
    percentile: float = 50,
) -> Segmentation:
    """Segment a raster (row, col, b1.., NULL for no-data)."""
    if centres is None:
        centres = km.fit(pixels, clusters, sample_percent, fixed_init)
    limit = km.max_difference(centres, max_diff, percentile)
    seg = clump(km.assign(pixels, centres), "cluster_id", four_connected)
    seg = eliminate_single_pixels(seg, pixels, four_connected)
    seg = cut_wide(eliminate_small_segments(seg, pixels, min_size, limit, four_connected))
    return Segmentation(cut(relabel(seg)), centres, limit)
