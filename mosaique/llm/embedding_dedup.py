"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length one; a cosine of at least ``cosine`` is then a
Euclidean distance of at most ``sqrt(2 - 2 cosine)``. Each table hashes a vector
by ``k`` projections on Gaussian directions, shifted and cut into steps of
``width``. ``k`` follows from the number of distinct vectors, so that a vector
meets some tens of unrelated ones per table at any size of the corpus, and the
number of tables from the chance ``miss`` with which a pair right at the
threshold may share no bucket. A bucket's rows carry a sketch of SKETCH signs of
projections alone; only rows with another nearby in its sketch fetch their
vectors, in single precision where that loses nothing, and are compared by exact
cosine in double precision. Projections are sums of whole numbers, so a vector's
keys are the same wherever they are computed.

Rows: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are kept. Vectors of different lengths never link. Equal
vectors are one class, compared once. A repeated vec_id counts as a further
vector; a null vec_id is never a component's id unless all its ids are null.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaique.llm.common import components, cut, hot_units, in_unit_batches, in_units, labels_of

#: Unrelated vectors of one bucket, on average, that the choice of ``k`` allows for; signs of a sketch.
STRANGERS, SKETCH = 32, 128
#: Whole numbers that stand for 1 in a projection; 2^53 holds the sums of vectors of some thousand dimensions.
GRID = 1 << 18


def meet(distance: float, width: float) -> float:
    """Chance that one projection puts two points ``distance`` apart into the same step (Datar et al., 2004)."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, width: float, miss: float) -> tuple[int, int]:
    """(projections per table, tables) for ``n`` distinct vectors."""
    near, far = meet(math.sqrt(2 - 2 * cosine), width), meet(math.sqrt(2), width)
    k = max(4, round(math.log(max(2.0, n / STRANGERS)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))


def sketch_distance(cosine: float) -> int:
    """Signs in which the sketches of a pair at the threshold differ at most, but for a chance of some 1e-7."""
    differ = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return min(SKETCH, round(SKETCH * differ + 5.5 * math.sqrt(SKETCH * differ * (1 - differ))))


class Hashes:
    """The tables' hash functions, the same on every executor for the same parameters."""

    def __init__(self, k: int, tables: int, width: float, seed: int):
        self.k, self.tables, self.width, self.seed = k, tables, width, seed
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _made(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if dim not in self.made:
            rng = np.random.default_rng([self.seed, dim])
            self.made[dim] = (
                np.rint(rng.standard_normal((dim, self.k * self.tables)) * GRID),
                np.rint(rng.uniform(0, self.width, self.k * self.tables) * GRID * GRID),
                rng.integers(-(2**62), 2**62, self.k, dtype=np.int64) | 1,
                np.rint(rng.standard_normal((dim, SKETCH)) * GRID),
            )
        return self.made[dim]

    def sketches(self, x: np.ndarray) -> np.ndarray:
        """Signs of projections of each row of ``x`` (unit vectors), as SKETCH / 64 signed longs."""
        signs = np.rint(x * GRID) @ self._made(x.shape[1])[3] > 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.int64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """int64 bucket key of each row of ``x`` (unit vectors) in each table."""
        directions, shift, mix, _ = self._made(x.shape[1])
        out = np.empty((len(x), self.tables), np.int64)
        for at in range(0, len(x), 2048):
            steps = np.floor((np.rint(x[at : at + 2048] * GRID) @ directions + shift) / (self.width * GRID * GRID))
            steps = steps.astype(np.int64).reshape(-1, self.tables, self.k)
            with np.errstate(over="ignore"):
                h = (steps * mix).sum(axis=2)
                h ^= (h >> 29) & 0x7FFFFFFFF
                out[at : at + 2048] = h * np.int64(-7046029254386353131)
        return out


def _vector(v) -> np.ndarray | None:
    """The vector in double precision, or None where it can link with nothing."""
    if v is None or not len(v):
        return None
    x = np.asarray([np.nan if c is None else c for c in v] if not isinstance(v, np.ndarray) else v, dtype=np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _scaled(x: np.ndarray) -> np.ndarray:
    """``x`` at length one."""
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _unit(v) -> np.ndarray | None:
    x = _vector(v)
    return None if x is None else _scaled(x)


def _packed(x: np.ndarray) -> bytes:
    """A letter for the precision and the vector's bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return b"f" + single.tobytes() if (single == x).all() else b"d" + x.astype("<f8").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    """The packed vector at length one."""
    return _scaled(np.frombuffer(b, "<f4" if b[:1] == b"f" else "<f8", offset=1).astype(np.float64))


def _classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw = [_vector(v) for v in pdf["embedding"]]
        yield pd.DataFrame(
            {
                "vec_id": pdf["vec_id"],
                "ck": [None if x is None else hashlib.blake2b(_scaled(x).tobytes(), digest_size=16).digest() for x in raw],
                "unit": [None if x is None else _packed(x) for x in raw],
            }
        )


def _bucketed(hashes: Hashes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            unit = [_unpacked(b) for b in pdf["unit"]]
            dims = np.fromiter(map(len, unit), np.int64, len(unit))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), 512):
                    some = own[at : at + 512]
                    x = np.stack([unit[i] for i in some])
                    sketch = hashes.sketches(x).repeat(hashes.tables, axis=0)
                    yield pd.DataFrame(
                        {
                            "node": np.repeat(pdf["node"].to_numpy()[some], hashes.tables),
                            "s0": sketch[:, 0],
                            "s1": sketch[:, 1],
                            "t": np.tile(np.arange(hashes.tables) + (int(dim) << 12), len(some)),
                            "key": hashes.keys(x).ravel(),
                        }
                    )

    return run


def _nearby(distance: int):
    """For :func:`in_unit_batches`: the rows that have another within ``distance`` in their unit."""

    def work(f: pd.DataFrame, stop: np.ndarray) -> pd.DataFrame | None:
        s0, s1 = (f[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))  # signed numbers would count bits of their size
        near = np.zeros(len(f), bool)
        d, i = 1, np.flatnonzero(stop > np.arange(len(f)) + 1)
        while len(i):
            j = i + d
            close = np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j]) <= distance
            near[i[close]] = near[j[close]] = True
            d += 1
            i = i[stop[i] > i + d]
        return f.loc[near, ["t", "key", "node", "blk", "lo", "hi"]] if near.any() else None

    return work


def _compared(hashes: Hashes, cosine: float):
    def work(unit: pd.DataFrame) -> pd.DataFrame | None:
        x = np.stack([_unpacked(b) for b in unit["unit"]])
        lo, hi, blk = (unit[c].to_numpy() for c in ("lo", "hi", "blk"))
        a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        if lo[0] != hi[0]:  # pairs within a block belong to that block's own unit
            across = blk[a] != blk[b]
            a, b = a[across], b[across]
        if not len(a):
            return None
        # a pair counts in the first table where it meets
        t = int(unit["t"].iloc[0]) & 0xFFF
        if t:
            some = np.unique(np.concatenate((a, b)))
            keys = np.zeros((len(x), t), np.int64)
            keys[some] = hashes.keys(x[some])[:, :t]
            first = np.ones(len(a), bool)
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                first[part] = ~(keys[a[part]] == keys[b[part]]).any(axis=1)
            a, b = a[first], b[first]
            if not len(a):
                return None
        size, low = unit["w"].to_numpy(), unit["node"].to_numpy()
        n = np.zeros(len(x), np.int64)
        np.add.at(n, a, size[b])
        np.add.at(n, b, size[a])
        root = labels_of(len(x), a, b)
        kept = np.flatnonzero(n)
        return pd.DataFrame({"u": low[kept], "v": low[root[kept]], "n": n[kept]})

    return work


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.95, width: float = 2.4, miss: float = 1e-4, seed: int = 20
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows = cut(
        vectors.select(F.col("vec_id").cast("string"), F.col("embedding").cast("array<double>"))
        .mapInPandas(_classed, "vec_id string, ck binary, unit binary")
        .withColumn("vec_id", F.col("vec_id").cast("long"))
    )
    valid = rows.where("ck IS NOT NULL")
    # a number of its own for each class, for it may have no vec_id to go by
    classes = cut(
        valid.groupBy("ck")
        .agg(F.min("vec_id").alias("low"), F.count("*").alias("w"), F.first("unit").alias("unit"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    hashes = Hashes(*plan(classes.count(), cosine, width, miss), width, seed)
    # keys and sketches alone are dealt out first; only rows with another nearby fetch their vectors
    keyed = classes.select("node", "unit").mapInPandas(_bucketed(hashes), "node long, s0 long, s1 long, t long, key long")
    units = hot_units(keyed, ["t", "key"], "node")
    near = _nearby(sketch_distance(cosine))
    near = in_unit_batches(units, ["t", "key"], near, "t long, key long, node long, blk int, lo int, hi int")
    units = near.join(classes.select("unit", "w", "node"), "node")
    linked = cut(in_units(units, ["t", "key"], _compared(hashes, cosine), "u long, v long, n long"))
    nodes = components(linked.select("u", "v"))
    links = linked.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    rooted = (
        classes.drop("unit")
        .join(links, "node", "left")
        .join(nodes, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select(
        "ck", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"
    )
    found = valid.select("vec_id", "ck").join(named, "ck").select("vec_id", "n_links", "component_id")
    alone = rows.where("ck IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return found.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    )
