"""SQL of iterated operators, as recursive common table expressions over a table ``r`` (row, col, b1, b2, b3).

Segmentations work on ``tile, row, col`` so that tiles run side by side; a whole
raster is tile 0. Each state of an iteration is a table; the last one counts.
"""

from __future__ import annotations

SUMS = ", ".join(f"CAST(sum(b{i}) AS BIGINT) AS s{i}" for i in (1, 2, 3))


def _distance(a: str, b: str) -> str:
    return " + ".join(f"({a.format(i)} - {b.format(i)}) * ({a.format(i)} - {b.format(i)})" for i in (1, 2, 3))


def lloyd(diagonal: str, rounds: int = 30, tolerance: str = "1e-4") -> str:
    """``km`` (cluster_id, c1, c2, c3): the centres ``c`` of ``diagonal`` after Lloyd rounds."""
    return f"""{diagonal}, lloyd(it, cluster_id, c1, c2, c3, going) AS (SELECT 0, cluster_id, c1, c2, c3, TRUE FROM c
UNION ALL SELECT n.it + 1, n.cluster_id, n.d1, n.d2, n.d3, max({_distance("n.c{}", "n.d{}")}) OVER () > {tolerance} * {tolerance} FROM (
  SELECT o.*, coalesce(m.m1, o.c1) AS d1, coalesce(m.m2, o.c2) AS d2, coalesce(m.m3, o.c3) AS d3 FROM lloyd o LEFT JOIN (
    SELECT best, avg(b1) AS m1, avg(b2) AS m2, avg(b3) AS m3 FROM (
      SELECT any_value(r.b1) AS b1, any_value(r.b2) AS b2, any_value(r.b3) AS b3,
        arg_min(c.cluster_id, ({_distance("r.b{}", "c.c{}")}, c.cluster_id)) AS best FROM r, lloyd c GROUP BY r.row, r.col) GROUP BY best
  ) m ON m.best = o.cluster_id WHERE o.going AND o.it < {rounds}) n),
km AS (SELECT cluster_id, c1, c2, c3 FROM lloyd WHERE it = (SELECT max(it) FROM lloyd))"""


def clusters() -> str:
    """``g`` (row, col, kind): the nearest of ``km``; ``lim`` (d): the median distance of centres."""
    return f"""g AS (SELECT r.row, r.col, arg_min(cluster_id, ({_distance("b{}", "c{}")}, cluster_id)) AS kind FROM r, km GROUP BY r.row, r.col),
lim AS (SELECT quantile_cont(sqrt({_distance("a.c{}", "b.c{}")}), 0.5) AS d FROM km a JOIN km b ON a.cluster_id < b.cluster_id)"""


def clumps(source: str, off: str) -> str:
    """``cl`` (tile, row, col, seg_id): components of equal ``kind`` in ``source`` (tile, row, col, kind)."""
    return f"""ce AS (SELECT a.tile, a.row * 100 + a.col AS u, b.row * 100 + b.col AS v FROM {source} a, {off}
JOIN {source} b ON b.tile = a.tile AND b.row = a.row + dr AND b.col = a.col + dc WHERE a.kind = b.kind),
ct(tile, u, v) AS (SELECT tile, row * 100 + col, row * 100 + col FROM {source}
UNION SELECT ct.tile, ct.u, ce.v FROM ct JOIN ce ON ct.tile = ce.tile AND ct.v = ce.u),
cl AS (SELECT tile, CAST(u // 100 AS INTEGER) AS row, CAST(u % 100 AS INTEGER) AS col, dense_rank() OVER (PARTITION BY tile ORDER BY root) AS seg_id
FROM (SELECT tile, u, min(v) AS root FROM ct GROUP BY tile, u))"""


def singles(source: str, off: str) -> str:
    """``sl`` (tile, row, col, seg_id): ``source`` after rounds in which single pixels join the nearest larger neighbour."""
    sized = "(SELECT s.*, count(*) OVER (PARTITION BY tile, seg_id) AS n FROM si s)"
    return f"""si(it, tile, row, col, seg_id, alone) AS (SELECT 0, tile, row, col, seg_id, CAST(NULL AS BIGINT) FROM {source}
UNION ALL SELECT w.it + 1, w.tile, w.row, w.col, coalesce(w.target, w.seg_id), w.alone FROM (
  SELECT o.it, o.tile, o.row, o.col, o.seg_id, o.alone AS before, m.target, coalesce(n.alone, 0) AS alone FROM si o
  LEFT JOIN (SELECT a.tile, a.row, a.col, arg_min(b.seg_id, ({_distance("x.b{}", "y.b{}")}, b.row, b.col)) AS target
    FROM {sized} a, {off} JOIN {sized} b ON b.tile = a.tile AND b.row = a.row + dr AND b.col = a.col + dc
    JOIN r x ON x.row = a.row AND x.col = a.col JOIN r y ON y.row = b.row AND y.col = b.col
    WHERE a.n = 1 AND b.n > 1 GROUP BY a.tile, a.row, a.col) m ON m.tile = o.tile AND m.row = o.row AND m.col = o.col
  LEFT JOIN (SELECT tile, count(*) AS alone FROM (SELECT tile, seg_id FROM si GROUP BY tile, seg_id HAVING count(*) = 1) GROUP BY tile) n ON n.tile = o.tile) w
  WHERE w.before IS NULL OR (w.alone > 0 AND w.alone <> w.before)),
sl AS (SELECT tile, row, col, seg_id FROM si QUALIFY it = max(it) OVER (PARTITION BY tile))"""


def smalls(source: str, off: str, least: int, limit: str, passes: int = 10) -> str:
    """``sf`` (tile, row, col, seg_id): ``source`` after merging segments below ``least`` pixels, the smallest size first."""
    turn = f"(q.merged = 0 OR q.left_over = 0 OR q.pass = {passes})"
    key = "tile * 10000000 + {}seg_id"  # one number, so that no plan joins by tile alone
    graph = f"SELECT tile, seg_id, {key.format('')} AS k, any_value(size) AS size, count(*) AS n, {SUMS} FROM sm JOIN r USING (row, col) GROUP BY tile, seg_id"
    return f"""sm(it, size, pass, tile, row, col, seg_id) AS (
SELECT 0, min(CASE WHEN n < {least} THEN n END) OVER (PARTITION BY tile), 1, tile, row, col, seg_id
FROM (SELECT *, count(*) OVER (PARTITION BY tile, seg_id) AS n FROM {source})
UNION ALL SELECT q.it + 1,
  CASE WHEN {turn} THEN min(CASE WHEN q.now > q.size AND q.now < {least} THEN q.now END) OVER (PARTITION BY q.tile) ELSE q.size END,
  CASE WHEN {turn} THEN 1 ELSE q.pass + 1 END, q.tile, q.row, q.col, q.next FROM (
  SELECT p.*, count(*) OVER (PARTITION BY p.tile, p.next) AS now,
    max(CASE WHEN p.target IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.tile) AS merged,
    max(CASE WHEN p.target IS NULL AND p.n = p.size THEN 1 ELSE 0 END) OVER (PARTITION BY p.tile) AS left_over FROM (
    SELECT o.*, z.n, t.target, coalesce(t.target, o.seg_id) AS next FROM sm o
    JOIN (SELECT tile, seg_id, count(*) AS n FROM sm GROUP BY tile, seg_id) z ON z.tile = o.tile AND z.seg_id = o.seg_id
    LEFT JOIN (SELECT tile, seg_id, arg_min(target, (d2, target)) AS target FROM (
      SELECT x.tile, x.seg_id, y.seg_id AS target, {_distance("x.s{} / x.n", "y.s{} / y.n")} AS d2 FROM ({graph}) x
      JOIN (SELECT DISTINCT a.{key.format("a.")} AS a, b.{key.format("b.")} AS b FROM sm a, {off} JOIN sm b ON b.tile = a.tile AND b.row = a.row + dr AND b.col = a.col + dc
        WHERE a.seg_id <> b.seg_id) e ON e.a = x.k
      JOIN ({graph}) y ON y.k = e.b WHERE x.n = x.size AND y.n > x.size
    ) GROUP BY tile, seg_id HAVING min(d2) <= {limit}) t ON t.tile = o.tile AND t.seg_id = o.seg_id
    WHERE o.size IS NOT NULL) p) q),
sf AS (SELECT tile, row, col, seg_id FROM sm QUALIFY it = max(it) OVER (PARTITION BY tile))"""
