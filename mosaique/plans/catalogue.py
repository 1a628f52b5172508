"""Registered queries of the raster engine, each beside the SQL that gives the same rows.

The ``events`` table is the raster (100 columns wide); ``lineitem`` gives zones
and values. Queries without SQL are iterated or fitted ones; tests hold those
against a second implementation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaique.functions.stats import MISSING
from mosaique.operators import cluster as km
from mosaique.operators import neighbours as nb
from mosaique.operators import rat as tables
from mosaique.operators import segmentation as sg
from mosaique.operators import spatial, subset, tiling, zonal
from mosaique.operators.zonal import Stat
from mosaique.plans import iterated as it
from mosaique.operators.graph import shared_dir
from mosaique.sources import raster
from mosaique.streaming.completion import OUT, check_complete, completed_segments

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_SLOW: dict[str, str] = {}

KINDS = ["click", "error", "purchase", "signup", "view"]
WIDTH = 100
GT = [1000.0, 30.0, 0.5, 5000.0, -0.25, -30.0]

#: The raster, its zones and its small blocks as common table expressions.
RASTER = """r AS (
  SELECT CAST(event_id // 100 AS INTEGER) AS row, CAST(event_id % 100 AS INTEGER) AS col,
         CAST(floor(value) AS BIGINT) AS b1, user_id AS b2, CAST(hour(ts) AS BIGINT) AS b3,
         list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS kind
  FROM events)"""
ZONES = RASTER + """, z AS (
  SELECT row, col, b1, b2, b3, kind, CAST(((row // 5) * 20 + col // 5) * 5 + kind AS BIGINT) AS seg_id FROM r)"""
SMALL = RASTER + """, z AS (
  SELECT row, col, b1, b2, b3, kind, CAST(((row // 3) * 40 + col // 3) * 5 + kind AS BIGINT) AS seg_id FROM r)"""
ITEMS = """v AS (
  SELECT l_suppkey + 1 AS seg_id, CASE WHEN l_quantity <> 25 THEN CAST(l_quantity AS BIGINT) END AS b1 FROM lineitem)"""
OFF4 = "(VALUES (-1, 0), (0, -1), (0, 1), (1, 0)) o(dr, dc)"
OFF8 = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(dr, dc)"


def query(sql: str | None = None, slow: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            (_SLOW if slow else _SQL)[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def slow_sql() -> dict[str, str]:
    """SQL that takes minutes on all but the smallest tables, for tests."""
    return dict(_SLOW)


def _kind() -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")


def _raster(spark: SparkSession, d: str) -> DataFrame:
    return raster.events_raster(spark, d, WIDTH).withColumn("kind", _kind())


def _zones(spark: SparkSession, d: str, side: int = 5) -> DataFrame:
    """The raster with zones: pixels of one kind in a square block."""
    across = 20 if side == 5 else 40
    zone = f"((row div {side}) * {across} + col div {side}) * 5 + kind"
    return _raster(spark, d).withColumn("seg_id", F.expr(zone).cast("bigint"))


def _items(spark: SparkSession, d: str, key: str = "l_suppkey") -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col(key) + 1).alias("seg_id"), F.when(F.col("l_quantity") != 25, q).alias("b1")
    )


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in places.items()})


# Zonal statistics


@query(f"""WITH {ITEMS} SELECT seg_id, min(b1) AS lo, max(b1) AS hi, round(CAST(avg(b1) AS DOUBLE), 3) AS mean,
round(CAST(stddev_pop(b1) AS DOUBLE), 3) AS sd, count(b1) AS n FROM v GROUP BY seg_id""")
def zonal_basic(spark: SparkSession, d: str) -> DataFrame:
    want = [Stat("lo", "min"), Stat("hi", "max"), Stat("mean", "mean"), Stat("sd", "stddev"), Stat("n", "pixcount")]
    return _rounded(zonal.zonal_stats(_items(spark, d), want), mean=3, sd=3)


_PCT = ", ".join(
    f"min(CASE WHEN cum >= tot * ({p} / 100.0) THEN b1 END) AS {name}" for name, p in (("p7", 7), ("p25", 25), ("median", 50), ("p95", 95))
)


@query(f"""WITH {ITEMS}, h AS (SELECT seg_id, b1, count(*) AS n FROM v WHERE b1 IS NOT NULL GROUP BY ALL),
c AS (SELECT seg_id, b1, sum(n) OVER (PARTITION BY seg_id ORDER BY b1) AS cum, sum(n) OVER (PARTITION BY seg_id) AS tot FROM h)
SELECT seg_id, {_PCT}, max(b1) AS p0 FROM c GROUP BY seg_id""")
def zonal_median_pct(spark: SparkSession, d: str) -> DataFrame:
    want = [Stat("p7", "percentile", param=7), Stat("p25", "percentile", param=25.9), Stat("median", "median")]
    want += [Stat("p95", "percentile", param=95), Stat("p0", "percentile", param=0)]
    return zonal.zonal_stats(_items(spark, d), want)


@query(f"""WITH {ITEMS}, h AS (SELECT seg_id, b1, count(*) AS n FROM v WHERE b1 IS NOT NULL GROUP BY ALL)
SELECT seg_id, arg_min(b1, (-n, b1)) AS mode FROM h GROUP BY seg_id""")
def zonal_mode(spark: SparkSession, d: str) -> DataFrame:
    return zonal.zonal_stats(_items(spark, d), [Stat("mode", "mode")])


@query("""WITH v AS (SELECT l_orderkey + 1 AS seg_id, CASE WHEN l_quantity <= 10 THEN CAST(l_quantity AS BIGINT) END AS b1 FROM lineitem)
SELECT seg_id, coalesce(min(b1), -9999) AS lo, coalesce(round(CAST(avg(b1) AS DOUBLE), 3), -9999) AS mean,
coalesce(mode, -9999) AS mode, count(b1) AS n FROM v LEFT JOIN (
  SELECT seg_id AS s, arg_min(b1, (-n, b1)) AS mode FROM (SELECT seg_id, b1, count(*) AS n FROM v WHERE b1 IS NOT NULL GROUP BY ALL) GROUP BY ALL
) ON seg_id = s GROUP BY seg_id, mode""")
def zonal_missing(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d, "l_orderkey").withColumn("b1", F.when(F.col("b1") <= 10, F.col("b1")))
    want = [Stat("lo", "min"), Stat("mean", "mean"), Stat("mode", "mode"), Stat("n", "pixcount")]
    return _rounded(zonal.zonal_stats(rows, want), mean=3)


@query(f"""WITH {ZONES} SELECT seg_id, min(b1) AS Band_1_min, round(CAST(avg(b1) AS DOUBLE), 3) AS Band_1_mean,
min(b2) AS Band_2_min, round(CAST(avg(b2) AS DOUBLE), 3) AS Band_2_mean FROM z GROUP BY seg_id""")
def zonal_all_bands(spark: SparkSession, d: str) -> DataFrame:
    want = zonal.named_stats([1, 2], ["min", "mean"])
    return _rounded(zonal.zonal_stats(_zones(spark, d), want), Band_1_mean=3, Band_2_mean=3)


@query(f"""WITH {ZONES} SELECT a.seg_id, sum(b.b1) AS total, count(*) AS n FROM z a JOIN r b ON a.row = b.row AND a.col = b.col GROUP BY ALL""")
def zonal_overlay(spark: SparkSession, d: str) -> DataFrame:
    both = zonal.overlay(_zones(spark, d), _raster(spark, d))
    return both.groupBy("seg_id").agg(F.sum("b1").alias("total"), F.count("*").alias("n"))


@query(f"WITH {ZONES} SELECT seg_id, count(*) AS n FROM z GROUP BY ALL")
def seg_histogram(spark: SparkSession, d: str) -> DataFrame:
    return zonal.segment_sizes(_zones(spark, d))


@query("""SELECT seg_id, sum(n) AS n FROM (SELECT o_custkey + 1 AS seg_id, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT user_id + 1, count(*) FROM events GROUP BY ALL) GROUP BY ALL""")
def hist_merge(spark: SparkSession, d: str) -> DataFrame:
    def sizes(name: str, key: str) -> DataFrame:
        return zonal.segment_sizes(spark.read.parquet(f"{d}/{name}.parquet").select((F.col(key) + 1).alias("seg_id")))

    return zonal.merge_histograms(sizes("orders", "o_custkey"), sizes("events", "user_id"))


@query(f"""WITH {ZONES}, h AS (SELECT seg_id, count(*) AS n FROM z GROUP BY ALL),
c AS (SELECT seg_id, n, sum(n) OVER (ORDER BY seg_id) AS cum, sum(n) OVER () AS tot FROM h)
SELECT min(seg_id) AS minimum, max(seg_id) AS maximum, round(sum(seg_id * n) / sum(n), 4) AS mean,
round((SELECT stddev_pop(seg_id) FROM z), 3) AS stddev, arg_min(seg_id, (-n, seg_id)) AS mode,
min(CASE WHEN cum * 2 >= tot THEN seg_id END) AS median FROM c""")
def hist_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zonal.histogram_summary(zonal.segment_sizes(_zones(spark, d))), mean=4, stddev=3)


@query(f"WITH {ITEMS} SELECT seg_id, b1 AS value, count(*) AS n FROM v WHERE b1 IS NOT NULL GROUP BY ALL")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return zonal.value_histogram(_items(spark, d))


@query(f"WITH {ITEMS} SELECT seg_id, count(b1) AS n_valid, count(*) - count(b1) AS n_nodata FROM v GROUP BY ALL")
def nodata_counts(spark: SparkSession, d: str) -> DataFrame:
    return zonal.nodata_counts(_items(spark, d))


def _orders_rat(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(
        (F.col("o_orderkey") + 1).alias("seg_id"), (F.col("o_orderkey") % 7).alias("Histogram"), F.col("o_custkey").alias("cust")
    )


@query("""SELECT o_orderkey + 1 AS seg_id, o_orderkey % 7 AS expected, coalesce(k, 0) AS found FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey
WHERE o_orderkey % 7 <> coalesce(k, 0)""")
def incomplete_segments(spark: SparkSession, d: str) -> DataFrame:
    return zonal.incomplete_segments(_orders_rat(spark, d), _items(spark, d, "l_orderkey"))


@query("""SELECT i AS seg_id FROM (SELECT unnest(range(1, (SELECT max(l_orderkey) + 2 FROM lineitem))) AS i)
WHERE i NOT IN (SELECT l_orderkey + 1 FROM lineitem)""")
def empty_segments(spark: SparkSession, d: str) -> DataFrame:
    return zonal.empty_segments(zonal.segment_sizes(_items(spark, d, "l_orderkey")))


@query(f"WITH {ZONES} SELECT seg_id, count(*) AS n, CAST(sum(b1) AS BIGINT) AS s1, CAST(sum(b2) AS BIGINT) AS s2 FROM z GROUP BY ALL")
def spectral_sums(spark: SparkSession, d: str) -> DataFrame:
    return zonal.spectral_sums(_zones(spark, d), ["b1", "b2"])


# Reading and sampling


@query(f"WITH {RASTER} SELECT row, col, b1 = 0 OR b2 = 0 OR b3 = 0 AS is_null FROM r")
def null_mask(spark: SparkSession, d: str) -> DataFrame:
    own = raster.with_nodata(_raster(spark, d), 0)
    return own.select("row", "col", raster.is_null(own).alias("is_null"))


@query(f"WITH {RASTER} SELECT row, col, b2 AS b1, b1 AS b2 FROM r WHERE row BETWEEN 3 AND 7 AND col BETWEEN 10 AND 59")
def window_read(spark: SparkSession, d: str) -> DataFrame:
    return raster.window(raster.select_bands(_raster(spark, d), [2, 1]), 10, 3, 50, 5)


@query(f"""WITH {RASTER}, k AS (SELECT *, row_number() OVER (ORDER BY row, col) - 1 AS i FROM r WHERE b1 <> 0 AND b2 <> 0 AND b3 <> 0)
SELECT row, col, b1 FROM k WHERE i % 14 = 0""")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return km.systematic_sample(raster.with_nodata(_raster(spark, d), 0), 7).select("row", "col", "b1")


@query(f"WITH {RASTER} SELECT row, col, b1 FROM r WHERE (row % 32) % 3 = 0 AND (col % 32) % 3 = 0")
def block_sample(spark: SparkSession, d: str) -> DataFrame:
    return raster.subsample(_raster(spark, d), 0.3, 32).select("row", "col", "b1")


@query(f"WITH {RASTER} SELECT row // 2 AS row, col // 2 AS col, b1 FROM r WHERE row % 2 = 1 AND col % 2 = 1")
def overview(spark: SparkSession, d: str) -> DataFrame:
    return tables.overview(_raster(spark, d).select("row", "col", "b1"), 2)


# Clustering

_BOX = "b AS (SELECT min(b1) AS l1, max(b1) AS h1, min(b2) AS l2, max(b2) AS h2, min(b3) AS l3, max(b3) AS h3 FROM r)"


def _diagonal(k: int) -> str:
    at = ", ".join(f"CAST(trunc(l{i} + j * (h{i} - l{i}) / {k + 1}.0::DOUBLE) AS DOUBLE) AS c{i}" for i in (1, 2, 3))
    return f"{RASTER}, {_BOX}, c AS (SELECT CAST(j AS INTEGER) AS cluster_id, {at} FROM b, range(1, {k + 1}) t(j))"


@query(f"WITH {_diagonal(8)} SELECT cluster_id, c1, c2, c3 FROM c")
def diagonal_centres(spark: SparkSession, d: str) -> DataFrame:
    return km.diagonal_centres(_raster(spark, d), 8)


@query(f"""WITH {_diagonal(8)}, d AS (SELECT row, col, cluster_id, row_number() OVER (PARTITION BY row, col ORDER BY
(b1 - c1) * (b1 - c1) + (b2 - c2) * (b2 - c2) + (b3 - c3) * (b3 - c3), cluster_id) AS i FROM r, c)
SELECT row, col, cluster_id FROM d WHERE i = 1""")
def assign_clusters(spark: SparkSession, d: str) -> DataFrame:
    own = _raster(spark, d)
    return km.assign(own, km.diagonal_centres(own, 8)).select("row", "col", "cluster_id")


@query(f"""WITH {_diagonal(8)}, p AS (SELECT sqrt((a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2 + (a.c3 - b.c3) ** 2) AS d
FROM c a JOIN c b ON a.cluster_id < b.cluster_id)
SELECT round(quantile_cont(d, 0.5), 4) AS auto, round(10 * max(d), 4) AS none FROM p""")
def max_spectral_diff(spark: SparkSession, d: str) -> DataFrame:
    c = km.diagonal_centres(_raster(spark, d), 8)
    found = km.centre_distances(c).agg(F.percentile("d", 0.5).alias("auto"), (10 * F.max("d")).alias("none"))
    return _rounded(found, auto=4, none=4)


@query(f"""WITH {_diagonal(3)} SELECT '[' || string_agg('[' || c1 || ',' || c2 || ',' || c3 || ']', ',' ORDER BY cluster_id) || ']' AS json FROM c""")
def centres_json(spark: SparkSession, d: str) -> DataFrame:
    return km.centres_json(km.diagonal_centres(_raster(spark, d), 3))


@query(f"WITH RECURSIVE {it.lloyd(_diagonal(6))} SELECT * FROM km")
def kmeans_fixed(spark: SparkSession, d: str) -> DataFrame:
    return km.fit(_raster(spark, d), 6, 100, fixed_init=True)


@query()
def kmeans_parallel(spark: SparkSession, d: str) -> DataFrame:
    return km.fit(_raster(spark, d), 6, 100)


# Neighbourhoods


def _pairs(off: str) -> str:
    return f"""WITH {RASTER} SELECT a.row, a.col, a.b1, b.row AS n_row, b.col AS n_col, b.b1 AS n_b1
FROM r a, {off} JOIN r b ON b.row = a.row + dr AND b.col = a.col + dc"""


@query(_pairs(OFF4))
def neighbours4(spark: SparkSession, d: str) -> DataFrame:
    return nb.neighbour_pairs(_raster(spark, d).select("row", "col", "b1"))


@query(_pairs(OFF8))
def neighbours8(spark: SparkSession, d: str) -> DataFrame:
    return nb.neighbour_pairs(_raster(spark, d).select("row", "col", "b1"), four_connected=False)


@query(f"""WITH {SMALL} SELECT DISTINCT a.seg_id AS a, b.seg_id AS b FROM z a, {OFF4}
JOIN z b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.seg_id <> b.seg_id""")
def adjacent_segments(spark: SparkSession, d: str) -> DataFrame:
    return nb.adjacent_segments(_zones(spark, d, 3))


_NEAREST = f"""WITH {SMALL}, s AS (SELECT seg_id, count(*) AS n FROM z GROUP BY ALL), y AS (SELECT z.*, n FROM z JOIN s USING (seg_id)),
near AS (SELECT a.row, a.col, a.seg_id, b.seg_id AS target, row_number() OVER (PARTITION BY a.row, a.col ORDER BY
(a.b1 - b.b1) * (a.b1 - b.b1) + (a.b2 - b.b2) * (a.b2 - b.b2) + (a.b3 - b.b3) * (a.b3 - b.b3), b.row, b.col) AS i
FROM y a, {OFF4} JOIN y b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.n = 1 AND b.n > 1) """


@query(_NEAREST + "SELECT row, col, seg_id, target FROM near WHERE i = 1")
def nearest_pixel(spark: SparkSession, d: str) -> DataFrame:
    own = _zones(spark, d, 3)
    return sg.nearest_neighbour_pixels(own.select("row", "col", "seg_id"), own.select("row", "col", "b1", "b2", "b3"))


@query(_NEAREST + "SELECT z.row, z.col, coalesce(target, z.seg_id) AS seg_id FROM z LEFT JOIN near ON z.row = near.row AND z.col = near.col AND i = 1")
def single_round(spark: SparkSession, d: str) -> DataFrame:
    own = _zones(spark, d, 3)
    return sg.merge_single_pixels(own.select("row", "col", "seg_id"), own.select("row", "col", "b1", "b2", "b3"))


def _clump_sql(off: str) -> str:
    return f"""WITH RECURSIVE {RASTER}, e AS (SELECT a.row * 100 + a.col AS u, b.row * 100 + b.col AS v FROM r a, {off}
JOIN r b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.kind = b.kind),
t(u, v) AS (SELECT row * 100 + col, row * 100 + col FROM r UNION SELECT t.u, e.v FROM t JOIN e ON t.v = e.u),
m AS (SELECT u, min(v) AS root FROM t GROUP BY u)
SELECT CAST(u // 100 AS INTEGER) AS row, CAST(u % 100 AS INTEGER) AS col, dense_rank() OVER (ORDER BY root) AS seg_id FROM m"""


@query(_clump_sql(OFF4))
def clump4(spark: SparkSession, d: str) -> DataFrame:
    return sg.clump(_raster(spark, d), "kind")


@query(_clump_sql(OFF8))
def clump8(spark: SparkSession, d: str) -> DataFrame:
    return sg.clump(_raster(spark, d), "kind", four_connected=False)


_GRAPH = f"""{SMALL}, n AS (SELECT seg_id, count(*) AS n, CAST(sum(b1) AS BIGINT) AS s1, CAST(sum(b2) AS BIGINT) AS s2 FROM z GROUP BY ALL),
e AS (SELECT DISTINCT a.seg_id AS a, b.seg_id AS b FROM z a, {OFF4} JOIN z b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.seg_id <> b.seg_id),
m AS (SELECT x.seg_id, y.seg_id AS target, (x.s1 / x.n - y.s1 / y.n) * (x.s1 / x.n - y.s1 / y.n) + (x.s2 / x.n - y.s2 / y.n) * (x.s2 / x.n - y.s2 / y.n) AS d2
FROM n x JOIN e ON x.seg_id = a JOIN n y ON y.seg_id = b WHERE x.n = 2 AND y.n > 2),
w AS (SELECT seg_id, arg_min(target, (d2, target)) AS target, min(d2) AS d2 FROM m GROUP BY ALL HAVING min(d2) <= 3600)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = _zones(spark, d, 3)
    return zonal.spectral_sums(own, ["b1", "b2"]), nb.adjacent_segments(own)


@query(f"WITH {_GRAPH} SELECT seg_id, target FROM w")
def best_merge(spark: SparkSession, d: str) -> DataFrame:
    return sg.merge_targets(*_graph(spark, d), 2, 60)


@query(f"""WITH {_GRAPH} SELECT coalesce(target, n.seg_id) AS seg_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s1) AS BIGINT) AS s1,
CAST(sum(s2) AS BIGINT) AS s2 FROM n LEFT JOIN w USING (seg_id) GROUP BY ALL""")
def merge_apply(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return sg.apply_merges(nodes, edges, sg.merge_targets(nodes, edges, 2, 60))[0]


@query(f"""WITH {_GRAPH} SELECT DISTINCT coalesce(x.target, a) AS a, coalesce(y.target, b) AS b FROM e LEFT JOIN w x ON x.seg_id = a
LEFT JOIN w y ON y.seg_id = b WHERE coalesce(x.target, a) <> coalesce(y.target, b)""")
def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return sg.apply_merges(nodes, edges, sg.merge_targets(nodes, edges, 2, 60))[1]


@query(f"WITH {SMALL} SELECT row, col, dense_rank() OVER (ORDER BY seg_id) AS seg_id FROM z")
def relabel(spark: SparkSession, d: str) -> DataFrame:
    return sg.relabel(_zones(spark, d, 3).select("row", "col", "seg_id"))


_WHOLE = "k0 AS (SELECT 0 AS tile, row, col, kind FROM {})"
_SEGMENTED = f"{it.clumps('k0', OFF4)}, {it.singles('cl', OFF4)}, {it.smalls('sl', OFF4, 6, '(SELECT d * d FROM lim)')}"


@query(f"WITH RECURSIVE {RASTER}, {_WHOLE.format('r')}, {it.clumps('k0', OFF4)}, {it.singles('cl', OFF4)} SELECT row, col, seg_id FROM sl")
def eliminate_single(spark: SparkSession, d: str) -> DataFrame:
    own = _raster(spark, d)
    return sg.eliminate_single_pixels(sg.clump(own, "kind"), own.drop("kind"))


@query(f"WITH RECURSIVE {RASTER}, {_WHOLE.format('r')}, {it.clumps('k0', OFF8)}, {it.smalls('cl', OFF8, 6, '6400')} SELECT row, col, seg_id FROM sf", slow=True)
def eliminate_small(spark: SparkSession, d: str) -> DataFrame:
    own = _raster(spark, d)
    return sg.eliminate_small_segments(sg.clump(own, "kind", False), own.drop("kind"), 6, 80, False)


@query(f"""WITH RECURSIVE {it.lloyd(_diagonal(8))}, {it.clusters()}, {_WHOLE.format('g')}, {_SEGMENTED}
SELECT row, col, dense_rank() OVER (ORDER BY seg_id) AS seg_id FROM sf""", slow=True)
def segment_raster(spark: SparkSession, d: str) -> DataFrame:
    return sg.segment(_raster(spark, d).drop("kind"), 8, 100, 6, fixed_init=True).seg


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Segment the raster and summarise the segments."""
    own = _raster(spark, d).drop("kind")
    done = sg.segment(own, 8, 100, 6, fixed_init=True)
    means = [Stat("n", "pixcount"), *(Stat(f"mean_{b}", "mean", b) for b in ("b1", "b2", "b3"))]
    return zonal.zonal_stats(zonal.overlay(done.seg, own), means)


# Tiles

TILE, OVERLAP = 32, 8


def _height(spark: SparkSession, d: str) -> int:
    return spark.read.parquet(f"{d}/events.parquet").count() // WIDTH


def _axis_sql(name: str, size: str) -> str:
    step = TILE - OVERLAP
    return f"""{name} AS (SELECT i, i * {step} AS pos, CASE WHEN i * {step} + {2 * TILE} > n THEN n - i * {step} ELSE {TILE} END AS len
FROM (SELECT {size} AS n), range(0, 10000) t(i) WHERE i = 0 OR (i - 1) * {step} + {2 * TILE} <= n)"""


_TILES = f"{RASTER}, {_axis_sql('xs', '100')}, {_axis_sql('ys', '(SELECT max(row) + 1 FROM r)')}"


@query(f"""WITH {_TILES} SELECT CAST(xs.i AS INTEGER) AS tcol, CAST(ys.i AS INTEGER) AS trow, CAST(xs.pos AS INTEGER) AS xpos,
CAST(ys.pos AS INTEGER) AS ypos, CAST(xs.len AS INTEGER) AS xsize, CAST(ys.len AS INTEGER) AS ysize FROM xs, ys""")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return tiling.tile_table(spark, WIDTH, _height(spark, d), TILE, OVERLAP).select("tcol", "trow", "xpos", "ypos", "xsize", "ysize")


_PLACED = f"""{_TILES}, t AS (SELECT CAST(xs.i AS INTEGER) AS tcol, CAST(ys.i AS INTEGER) AS trow, r.*, xs.pos AS xpos, ys.pos AS ypos,
xs.len AS xlen, ys.len AS ylen FROM r JOIN xs ON col >= xs.pos AND col < xs.pos + xs.len JOIN ys ON row >= ys.pos AND row < ys.pos + ys.len)"""


@query(f"WITH {_PLACED} SELECT tcol, trow, row, col, b1 FROM t")
def tile_explode(spark: SparkSession, d: str) -> DataFrame:
    own = _raster(spark, d).select("row", "col", "b1")
    return tiling.explode_tiles(own, WIDTH, _height(spark, d), TILE, OVERLAP)


_NAMED = _PLACED + ", s AS (SELECT *, CAST((row // 6 * 50 + col // 6) * 5 + kind AS BIGINT) + tcol + trow AS local_id FROM t)"


def _tile_seg(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every tile with ids of its own for the pixels of one kind in a block."""
    h = _height(spark, d)
    own = tiling.explode_tiles(_raster(spark, d), WIDTH, h, TILE, OVERLAP)
    named = own.withColumn("local_id", F.expr("(row div 6 * 50 + col div 6) * 5 + kind").cast("bigint") + F.col("tcol") + F.col("trow"))
    return named.select("tcol", "trow", "row", "col", "local_id"), tiling.tile_table(spark, WIDTH, h, TILE, OVERLAP)


@query(f"""WITH {_NAMED} SELECT tcol, trow, local_id FROM s WHERE tcol > 0 AND col - xpos < {OVERLAP} GROUP BY ALL
HAVING min(col - xpos) < {OVERLAP // 2} AND max(col - xpos) >= {OVERLAP // 2}""")
def midline(spark: SparkSession, d: str) -> DataFrame:
    seg, tiles = _tile_seg(spark, d)
    placed = seg.join(F.broadcast(tiles), ["tcol", "trow"]).withColumn("at", F.col("col") - F.col("xpos"))
    return tiling.crossing(placed.where((F.col("tcol") > 0) & (F.col("at") < OVERLAP)), OVERLAP)


_LINKS = f"""links AS (
SELECT tcol, trow, local_id, 0 AS rank, tcol - 1 AS to_tcol, trow AS to_trow FROM s WHERE tcol > 0 AND col - xpos < {OVERLAP} GROUP BY ALL
HAVING min(col - xpos) < {OVERLAP // 2} AND max(col - xpos) >= {OVERLAP // 2} UNION ALL
SELECT tcol, trow, local_id, 1, tcol, trow - 1 FROM s WHERE trow > 0 AND row - ypos < {OVERLAP} GROUP BY ALL
HAVING min(row - ypos) < {OVERLAP // 2} AND max(row - ypos) >= {OVERLAP // 2}),
c AS (SELECT l.*, b.local_id AS to_id, count(*) AS n FROM links l JOIN s a USING (tcol, trow, local_id)
JOIN s b ON b.tcol = to_tcol AND b.trow = to_trow AND b.row = a.row AND b.col = a.col
WHERE (rank = 0 AND a.col - a.xpos < {OVERLAP}) OR (rank = 1 AND a.row - a.ypos < {OVERLAP}) GROUP BY ALL),
m AS (SELECT tcol, trow, local_id, rank, to_tcol, to_trow, arg_min(to_id, (-n, to_id)) AS to_id FROM c GROUP BY ALL),
l AS (SELECT tcol, trow, local_id, to_tcol, to_trow, to_id FROM m QUALIFY row_number() OVER (PARTITION BY tcol, trow, local_id ORDER BY rank) = 1)"""


@query(f"WITH {_NAMED}, {_LINKS} SELECT * FROM l")
def overlap_mode(spark: SparkSession, d: str) -> DataFrame:
    return tiling.overlap_links(*_tile_seg(spark, d), OVERLAP)


_BOXES = f"""k AS (SELECT *, xpos + CASE WHEN tcol > 0 THEN {OVERLAP // 2} ELSE 0 END AS lo,
xpos + xlen - CASE WHEN tcol < (SELECT max(tcol) FROM t) THEN {OVERLAP // 2} ELSE 0 END AS hi,
ypos + CASE WHEN trow > 0 THEN {OVERLAP // 2} ELSE 0 END AS top,
ypos + ylen - CASE WHEN trow < (SELECT max(trow) FROM t) THEN {OVERLAP // 2} ELSE 0 END AS bottom FROM s),
o AS (SELECT tcol, trow, local_id, min(col) >= any_value(lo) AND min(col) < any_value(hi) AND min(row) >= any_value(top) AND min(row) < any_value(bottom) AS owned
FROM k GROUP BY tcol, trow, local_id)"""


@query(f"WITH {_NAMED}, {_BOXES} SELECT * FROM o")
def bbox_owner(spark: SparkSession, d: str) -> DataFrame:
    return tiling.box_owners(*_tile_seg(spark, d))


@query(f"""WITH RECURSIVE {_NAMED}, {_LINKS}, {_BOXES},
kept AS (SELECT * FROM k WHERE col >= lo AND col < hi AND row >= top AND row < bottom),
reach AS (SELECT DISTINCT tcol, trow, local_id, tcol AS rc, trow AS rr, local_id AS rid FROM kept WHERE local_id <> 0
  UNION ALL SELECT r.tcol, r.trow, r.local_id, to_tcol, to_trow, to_id FROM reach r JOIN l ON l.tcol = rc AND l.trow = rr AND l.local_id = rid),
root AS (SELECT r.* FROM reach r ANTI JOIN l ON l.tcol = rc AND l.trow = rr AND l.local_id = rid),
ids AS (SELECT rr, rc, rid, row_number() OVER (ORDER BY rr, rc, rid) AS seg_id FROM (SELECT DISTINCT rr, rc, rid FROM root) d
  JOIN o ON o.tcol = rc AND o.trow = rr AND o.local_id = rid WHERE owned)
SELECT row, col, coalesce(seg_id, 0) AS seg_id FROM kept LEFT JOIN root USING (tcol, trow, local_id) LEFT JOIN ids USING (rr, rc, rid)""")
def stitch(spark: SparkSession, d: str) -> DataFrame:
    return tiling.stitch(*_tile_seg(spark, d), OVERLAP)


@query()
def segment_tiled(spark: SparkSession, d: str) -> DataFrame:
    own = _raster(spark, d).drop("kind")
    return tiling.segment_tiled(own, WIDTH, _height(spark, d), TILE, OVERLAP, 6, 8, 100, fixed_init=True).seg


# Subsets and attribute tables

_SUB = f"""{ZONES}, w AS (SELECT row - 1 AS row, col - 7 AS col, seg_id AS old_id FROM z WHERE row BETWEEN 1 AND 8 AND col BETWEEN 7 AND 80),
f AS (SELECT old_id, min((row // 4, col // 4, row, col)) AS first FROM w GROUP BY ALL),
n AS (SELECT old_id, dense_rank() OVER (ORDER BY first) AS seg_id FROM f)"""


def _subset(spark: SparkSession, d: str, mask: DataFrame | None = None) -> subset.Subset:
    own = _zones(spark, d)
    table = own.groupBy("seg_id").agg(F.count("*").alias("Histogram"), F.max("b2").alias("user"))
    return subset.subset(
        own.select("row", "col", "seg_id"), table, 7, 1, 74, 8, (WIDTH, 10**6), mask, "orig", 4
    )


@query(f"WITH {_SUB} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, seg_id FROM w JOIN n USING (old_id)")
def subset_window(spark: SparkSession, d: str) -> DataFrame:
    return _subset(spark, d).seg


@query(f"""WITH {_SUB} SELECT n.seg_id, max(z.b2) AS "user", old_id AS orig, (SELECT count(*) FROM w WHERE w.old_id = n.old_id) AS "Histogram"
FROM n JOIN z ON z.seg_id = old_id GROUP BY n.seg_id, old_id""")
def subset_rat(spark: SparkSession, d: str) -> DataFrame:
    return _subset(spark, d).rat


@query(f"""WITH {_SUB}, mw AS (SELECT w.* FROM w JOIN r ON r.row = w.row AND r.col = w.col WHERE r.kind <> 3),
mf AS (SELECT old_id, min((row // 4, col // 4, row, col)) AS first FROM mw GROUP BY ALL)
SELECT old_id, dense_rank() OVER (ORDER BY first) AS seg_id FROM mf""")
def subset_mask(spark: SparkSession, d: str) -> DataFrame:
    mask = _raster(spark, d).select("row", "col", F.when(F.col("kind") == 3, 0).otherwise(1).alias("m"))
    return _subset(spark, d, mask).recode


@query("""SELECT seg_id, "user", n AS "Histogram" FROM (SELECT s_suppkey + 1 AS seg_id, s_nationkey AS "user" FROM supplier)
LEFT JOIN (SELECT l_suppkey + 1 AS s, count(*) AS n FROM lineitem GROUP BY ALL) ON seg_id = s WHERE seg_id BETWEEN 3 AND 60""")
def rat_range(spark: SparkSession, d: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 1).alias("seg_id"), F.col("s_nationkey").alias("user"))
    return tables.read_range(tables.with_histogram(table, zonal.segment_sizes(_items(spark, d))), 3, 60)


@query(f"WITH {ZONES} SELECT row, col, seg_id, n AS size FROM z JOIN (SELECT seg_id, count(*) AS n FROM z GROUP BY ALL) USING (seg_id)")
def pixel_attribute(spark: SparkSession, d: str) -> DataFrame:
    own = _zones(spark, d).select("row", "col", "seg_id")
    return tables.pixel_attribute(own, zonal.segment_sizes(own).withColumnRenamed("n", "size"), "size")


@query("""WITH q AS (SELECT quantile_cont(s_acctbal, 0.05) AS a, quantile_cont(s_acctbal, 0.95) AS b FROM supplier)
SELECT s_suppkey + 1 AS seg_id, CAST(floor(255 * least(1, greatest(0, (s_acctbal - a) / (b - a)))) AS INTEGER) AS "Red",
CAST(floor(255 * least(1, greatest(0, (s_acctbal - a) / (b - a)))) AS INTEGER) AS "Green",
0 AS "Blue", 255 AS "Alpha" FROM supplier, q""")
def colour_stretch(spark: SparkSession, d: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 1).alias("seg_id"), "s_acctbal", F.lit(1.0).alias("flat"))
    return tables.stretched_colours(table, "s_acctbal", "s_acctbal", "flat")


@query(f"""WITH {ZONES}, h AS (SELECT DISTINCT seg_id, md5('0:' || seg_id) AS h FROM z) SELECT seg_id,
CAST('0x' || h[1:2] AS INTEGER) AS "Red", CAST('0x' || h[3:4] AS INTEGER) AS "Green", CAST('0x' || h[5:6] AS INTEGER) AS "Blue",
CASE WHEN seg_id = 0 THEN 0 ELSE 255 END AS "Alpha" FROM h""")
def random_colours(spark: SparkSession, d: str) -> DataFrame:
    return tables.random_colours(zonal.segment_sizes(_zones(spark, d)))


@query("""SELECT event_type AS name, round(sum(value), 3) AS total, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 4) AS lowerq,
round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS upperq, round(avg(value), 4) AS mean, count(*) AS count FROM events GROUP BY ALL""")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("name"), F.lit(0.0).alias("t0"), F.col("value").alias("t1"))
    return _rounded(tables.timing_summary(rows), total=3, lowerq=4, median=4, upperq=4, mean=4)


# Spatial statistics

_XY = f"round(avg({GT[0]} + {GT[1]} * col + {GT[2]} * row), 3) AS easting, round(avg({GT[3]} + {GT[4]} * col + {GT[5]} * row), 3) AS northing"


@query(f"WITH {ZONES} SELECT seg_id, {_XY} FROM z GROUP BY ALL")
def mean_coord(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(nb.mean_coordinates(_zones(spark, d), GT), easting=3, northing=3)


_XY_FLOAT = ", ".join(
    f"round(CAST(CAST(avg({g[0]} + {g[1]} * col + {g[2]} * row) AS FLOAT) AS DOUBLE), 3) AS {n}" for g, n in ((GT[:3], "easting"), (GT[3:], "northing"))
)


@query(f"WITH {ZONES} SELECT seg_id, {_XY_FLOAT} FROM z GROUP BY ALL")
def zonal_udf(spark: SparkSession, d: str) -> DataFrame:
    columns = [("easting", "float"), ("northing", "float")]
    return _rounded(spatial.spatial_stats(_zones(spark, d), columns, "mean_coord", GT), easting=3, northing=3)


def _edge_sql(off: str, full: int) -> str:
    return f"""WITH {ZONES}, k AS (SELECT a.row, a.col, a.seg_id, count(b.row) AS n FROM z a CROSS JOIN {off}
LEFT JOIN z b ON b.row = a.row + dr AND b.col = a.col + dc AND b.seg_id = a.seg_id GROUP BY ALL)
SELECT seg_id, count(*) FILTER (WHERE n < {full}) AS n_edge FROM k GROUP BY ALL"""


@query(_edge_sql(OFF4, 4))
def edge4(spark: SparkSession, d: str) -> DataFrame:
    return nb.edge_pixel_counts(_zones(spark, d))


@query(_edge_sql(OFF8, 8))
def edge8(spark: SparkSession, d: str) -> DataFrame:
    return nb.edge_pixel_counts(_zones(spark, d), four_connected=False)


@query(_edge_sql(OFF8, 8))
def edge8_udf(spark: SparkSession, d: str) -> DataFrame:
    return spatial.spatial_stats(_zones(spark, d), [("n_edge", "int")], "num_edge_pixels", False)


_VAR = ", ".join(f"coalesce(round(sqrt(avg(CASE WHEN bin = {i} THEN d END)), 3), {MISSING}) AS variogram{i}" for i in (1, 2, 3))
_VARIOGRAM = f"""WITH {ZONES}, p AS (SELECT a.seg_id, CAST(floor(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)) AS INTEGER) AS bin,
(a.b1 - b.b1) * (a.b1 - b.b1) AS d FROM z a JOIN z b ON a.seg_id = b.seg_id AND a.row < b.row AND a.col < b.col
AND b.row - a.row <= 3 AND b.col - a.col <= 3)
SELECT s.seg_id, {_VAR} FROM (SELECT DISTINCT seg_id FROM z) s LEFT JOIN p ON p.seg_id = s.seg_id AND bin <= 3 GROUP BY ALL"""


@query(_VARIOGRAM)
def variogram(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(nb.variogram(_zones(spark, d), 3), variogram1=3, variogram2=3, variogram3=3)


@query(_VARIOGRAM.replace(", 3), -9999)", ", 2), -9999)"))
def variogram_udf(spark: SparkSession, d: str) -> DataFrame:
    columns = [(f"variogram{i}", "float") for i in (1, 2, 3)]
    return _rounded(spatial.spatial_stats(_zones(spark, d), columns, "variogram", 3), variogram1=2, variogram2=2, variogram3=2)


@query("SELECT s_suppkey + 1 AS seg_id, s_nationkey AS \"user\" FROM supplier")
def rat_column(spark: SparkSession, d: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 1).alias("seg_id"), F.col("s_nationkey").alias("user"), "s_acctbal")
    return tables.read_column(table, "user")


@query("SELECT o_orderkey * 37 // 100000 * 100000 AS page, count(*) AS n FROM orders GROUP BY ALL")
def rat_pages(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/orders.parquet").select(tables.page_id(F.col("o_orderkey") * 37).alias("page"))
    return ids.groupBy("page").agg(F.count("*").alias("n"))


@query("""SELECT user_id + 1 AS seg_id, count(*) AS n, count(*) AS valid, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total,
min(CAST(floor(value) AS BIGINT)) AS low, max(CAST(floor(value) AS BIGINT)) AS high FROM events GROUP BY ALL""")
def stream_completion(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream: each user's segment is emitted when its last event has come."""
    name = f"completed_{uuid.uuid4().hex}"
    known = spark.read.parquet(f"{d}/events.parquet")
    sizes = known.groupBy((F.col("user_id") + 1).alias("seg_id")).agg(F.count("*").alias("expected"))
    stream = spark.readStream.schema(known.schema).parquet(f"{d}/events.parque[t]")
    rows = stream.select((F.col("user_id") + 1).alias("seg_id"), F.floor("value").cast("bigint").alias("value"))
    folder = f"{shared_dir(spark)}/{name}"
    query = completed_segments(rows.join(sizes, "seg_id")).writeStream.format("parquet").outputMode("append")
    run = query.option("checkpointLocation", f"{folder}-state").start(folder)
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    done = spark.read.schema(OUT).parquet(folder)
    check_complete(done, sizes)
    return done
