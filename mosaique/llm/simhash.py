"""SimHash near-duplicates by pigeonhole blocks.

Words are the runs of bytes other than ASCII white space of the lower-cased
text (A-Z only); a text's shingles are its runs of ``width`` words. Fingerprint
bit *i* is 1 if bit *i* is set in over half of the shingles' XXH64 values.
With 64 bits in ``blocks`` blocks, two fingerprints that differ in at most
``distance`` bits agree on some ``blocks - distance`` blocks; each such choice
of blocks is a table whose buckets are compared exactly.

:func:`one_of_each` finds near copies further apart, by the Jaccard similarity
of distinct shingles: its fingerprints are as long as the similarity needs, so
that close pairs share a block, and candidates are verified by Hamming distance
and then by their whole shingle sets.

Rows: null and empty texts have fingerprint zero, which links like any other.
Equal fingerprints are one class however many rows share it. A repeated doc_id
keeps its rows; a null doc_id keeps its row and is never a component's id
unless all ids of the component are null. An empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaique.llm.common import bucket_units, components, cut, hot_units, in_unit_batches, in_units, labels_of

BITS = 64
#: Shingle hashes held at once; longer texts are added up in pieces.
CHUNK = 1 << 15
#: Bits of a long fingerprint that go with each of its blocks, and rows of a block of a unit that compares whole sets.
SKETCH, SMALL = 128, 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total, n = np.zeros(BITS, np.int64), len(starts)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = [
            digest(joined[a:b], seed)
            for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        ]
        bits = np.unpackbits(
            np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter(
                (fingerprint(t, width, seed) for t in pdf["text"]), np.uint64, len(pdf)
            )
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    # long ids with nulls would turn into doubles in pandas, so they travel as text
    return (
        docs.select(F.col("doc_id").cast("string"), "text")
        .mapInPandas(run, "doc_id string, fp long")
        .select(F.col("doc_id").cast("long"), "fp")
    )


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` blocks, as signed longs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(own, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _linked(distance: int):
    def work(unit: pd.DataFrame) -> pd.DataFrame | None:
        fp = unit["fp"].to_numpy().view(np.uint64)
        lo, hi, blk = (unit[c].to_numpy() for c in ("lo", "hi", "blk"))
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
        a, b = np.nonzero(np.triu(near, 1))
        if lo[0] != hi[0]:  # pairs within a block belong to that block's own unit
            across = blk[a] != blk[b]
            a, b = a[across], b[across]
        if not len(a):
            return None
        own = unit["fp"].to_numpy()
        root = labels_of(len(own), a, b)
        moved = np.flatnonzero(root != np.arange(len(own)))
        return pd.DataFrame({"u": own[moved], "v": own[root[moved]]})

    return work


def near_links(classes: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Links (u, v) that join the fingerprints of ``classes`` (fp) as their pairs within ``distance`` would.

    Each unit of a bucket gives a spanning forest of its pairs, never the pairs
    themselves, so the links grow with the fingerprints and not with their square.
    """
    masks = block_masks(blocks, distance)
    tables = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
    rows = classes.select("fp", F.posexplode(tables).alias("t", "key"))
    units = bucket_units(rows, ["t", "key"], "fp")
    return in_units(units, ["t", "key"], _linked(distance), "u long, v long")


def near_duplicates(
    docs: DataFrame, distance: int = 2, blocks: int = 4, width: int = 3, seed: int = 42
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (its smallest doc_id)."""
    prints = cut(fingerprints(docs, width, seed))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    nodes = components(near_links(classes, distance, blocks))
    # components() names them by fingerprint; what is asked for is the smallest doc_id
    rooted = classes.join(nodes, classes.fp == nodes.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 values of the distinct shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


def majority(chunks: Iterator[np.ndarray], n: int, width: int) -> np.ndarray:
    """Of ``n`` rows of ``width`` words, given in chunks, the bits that over half of the rows have set.

    Bits are counted in place: three rows of one weight become their sum and a row of twice the weight.
    """
    levels: list[list[np.ndarray]] = []

    def add(at: int, rows: np.ndarray) -> None:
        while len(rows):
            if len(levels) <= at:
                levels.append([])
            rows, carry = np.concatenate([*levels[at], rows]), []
            while len(rows) > 2:
                k = len(rows) // 3
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                ab = a ^ b
                carry.append(a & b | ab & c)
                rows = np.concatenate((ab ^ c, rows[3 * k :]))
            levels[at] = [rows]
            rows, at = np.concatenate(carry) if carry else rows[:0], at + 1

    for chunk in chunks:
        add(0, chunk)
    at = 0
    while at < len(levels):
        rows = levels[at][0]
        if len(rows) == 2:
            levels[at] = [rows[:1] ^ rows[1:]]
            add(at + 1, rows[:1] & rows[1:])
        at += 1
    full = np.uint64(2**64 - 1)
    over, same = np.zeros(width, np.uint64), np.full(width, full)
    for at in reversed(range(max(len(levels), n.bit_length()))):
        bit = levels[at][0][0] if at < len(levels) and len(levels[at][0]) else np.zeros(width, np.uint64)
        if (n // 2) >> at & 1:
            same &= bit
        else:
            over |= same & bit
            same &= ~bit
    return over


def plan(n: int, similarity: float, miss: float) -> tuple[int, int, int]:
    """(bits of a block, blocks, bits of SKETCH that may differ) for ``n`` texts.

    Texts with Jaccard similarity s have shingle vectors with a cosine of 2s / (1 + s) at least, and a
    bit of their fingerprints differs with a chance of the angle over pi. Strangers share a block
    with a chance of one in 2^bits, so that a block's bucket holds some tens of them at any ``n``.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(60, max(6, math.ceil(math.log2(max(2, n))) - 5))
    met = (1 - differ) ** bits
    blocks = 1 if met >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-met)))
    return bits, blocks, min(SKETCH, round(SKETCH * differ + 5 * math.sqrt(SKETCH * differ * (1 - differ))))


class Blocks:
    """A long fingerprint as blocks of bits and a sketch, the same on every executor for the same parameters."""

    def __init__(self, bits: int, blocks: int, seed: int):
        self.bits, self.blocks, self.each = bits, blocks, 64 // bits
        n = -(-blocks // self.each) + SKETCH // 64
        rng = np.random.default_rng(seed)
        self.times = rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
        self.plus = rng.integers(0, 2**64, n, dtype=np.uint64)

    def _words(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(hashes), 4096):
            x = hashes[at : at + 4096, None] * self.times + self.plus
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            yield x

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, sketch) of a text's shingles, as signed longs."""
        words = majority(self._words(hashes), len(hashes), len(self.times))
        sketch, words = words[: SKETCH // 64], words[SKETCH // 64 :]
        steps = np.arange(self.each, dtype=np.uint64) * np.uint64(self.bits)
        out = words[:, None] >> steps & np.uint64((1 << self.bits) - 1)
        return out.ravel()[: self.blocks].astype(np.int64), sketch.view(np.int64)


def _marks(width: int, bits: int, blocks: int, seed: int):
    made = Blocks(bits, blocks, seed)

    @F.pandas_udf("ck binary, keys array<long>, s0 long, s1 long")
    def mark(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            own = shingles(t, width, seed)
            keys, sketch = made.of(own)
            rows.append((xxhash.xxh128_digest(own.tobytes()), keys, *sketch.tolist()))
        return pd.DataFrame(rows, columns=["ck", "keys", "s0", "s1"])

    return mark


def _sets(width: int, seed: int):
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width, seed).view(np.int64) for t in texts])

    return of


def _candidates(distance: int, by_root: bool):
    """For :func:`in_unit_batches`: links that join the rows of each unit as all its pairs within ``distance`` would.

    With ``by_root`` instead the rows that have a partner within ``distance`` under another root.
    """

    def work(f: pd.DataFrame, stop: np.ndarray) -> pd.DataFrame | None:
        n = len(f)
        node, blk = f["node"].to_numpy(), f["blk"].to_numpy()
        s0, s1 = (f[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))  # signed numbers would count bits of their size
        across = f["lo"].to_numpy() != f["hi"].to_numpy()
        root = f["root"].to_numpy() if by_root else np.arange(n)
        left, right, d, i = [], [], 1, np.flatnonzero(stop > np.arange(n) + 1)
        while len(i):
            j = i + d
            near = np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j]) <= distance
            # pairs within a block belong to that block's own unit
            near &= (root[i] != root[j]) & (~across[i] | (blk[i] != blk[j]))
            if near.any():
                left.append(i[near]), right.append(j[near])
                if not by_root:
                    root = labels_of(n, np.concatenate(left), np.concatenate(right))
            d += 1
            i = i[stop[i] > i + d]
        if not left:
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        if by_root:
            return f.iloc[np.unique(np.append(a, b))]
        return pd.DataFrame({"u": np.maximum(node[a], node[b]), "v": np.minimum(node[a], node[b])})

    return work


def linked(sets: list[np.ndarray], similarity: float, root: np.ndarray | None = None) -> np.ndarray:
    """Of each set the first of its component, where pairs with at least ``similarity`` are linked.

    ``root`` has components known before. A set is held against all that are not yet in its
    component, so that a group of copies costs little more than its size.
    """
    root = np.arange(len(sets)) if root is None else root.copy()
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    held = np.zeros(len(codes), bool)
    sums = np.zeros(len(codes) + 1, np.int64)
    for i in range(len(sets)):
        if (root == root[i]).all():
            break
        own = codes[starts[i] : ends[i]]
        held[own] = True
        np.cumsum(held[codes], out=sums[1:])
        held[own] = False
        both = sums[ends] - sums[starts]
        near = both >= similarity * (sizes + sizes[i] - both)
        met = np.unique(root[near & (root != root[i])])
        if len(met):
            root[np.isin(root, np.append(met, root[i]))] = min(met[0], root[i])
    return root


def _compared(similarity: float):
    def work(unit: pd.DataFrame) -> pd.DataFrame | None:
        node = unit["node"].to_numpy()
        _, first, back = np.unique(unit["root"].to_numpy(), return_index=True, return_inverse=True)
        before = first[back]
        root = linked([np.asarray(x, np.int64) for x in unit["shingles"]], similarity, before)
        moved = np.flatnonzero(root != before)
        return pd.DataFrame({"u": node[moved], "v": node[root[moved]]}) if len(moved) else None

    return work


class _Texts:
    """The near-copy search over classes of equal shingle sets."""

    def __init__(self, rows: DataFrame, classes: DataFrame, similarity: float, width: int, distance: int, seed: int):
        self.rows, self.classes, self.similarity, self.distance = rows, classes, similarity, distance
        self.sets_of = _sets(width, seed)

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The ``pairs`` (u, v) whose whole shingle sets, of ``sets`` (node, shingles), are similar."""
        a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
        b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        told = pairs.join(a, "u").join(b, "v").withColumn("both", both)
        return told.where(F.col("both") >= self.similarity * (F.size("a") + F.size("b") - F.col("both"))).select("u", "v")

    def components(self) -> DataFrame:
        """(node, root) of every class with a link to another."""
        keyed = self.classes.select("node", "s0", "s1", F.posexplode("keys").alias("t", "key"))
        found = _candidates(self.distance, False)
        todo = cut(in_unit_batches(hot_units(keyed, ["t", "key"], "node"), ["t", "key"], found, "u long, v long").distinct())
        # texts are dealt out once, for their sets alone, and only where there is a candidate
        ends = todo.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        own = self.rows.withColumnRenamed("row", "node").join(ends, "node", "left_semi")
        sets = cut(own.select("node", self.sets_of("text").alias("shingles")))
        # one candidate of each text first: where it holds, most others join what is joined already
        nodes = cut(components(cut(self.verified(todo.groupBy("u").agg(F.min("v").alias("v")), sets))))
        apart = cut(_apart(todo, nodes))
        if apart.isEmpty():
            return nodes
        nodes = _joined(nodes, cut(self.verified(apart.select("u", "v"), sets)))
        # what did not hold leaves open whether other pairs of the two components do
        ends = _apart(apart.select("u", "v"), nodes).select(F.explode(F.array("root_u", "root_v")).alias("root")).distinct()
        named = self.classes.join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
        some = named.join(ends, "root", "left_semi").select("node", "root", "s0", "s1", F.posexplode("keys").alias("t", "key"))
        units = hot_units(some, ["t", "key"], "node", SMALL)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
        rest = cut(in_unit_batches(units, ["t", "key"], _candidates(self.distance, True), schema))
        more = cut(in_units(rest.join(sets, "node"), ["t", "key"], _compared(self.similarity), "u long, v long"))
        return _joined(nodes, more)


def _apart(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, root_u, root_v) of the ``pairs`` that lie in two components."""
    for c in ("u", "v"):
        own = nodes.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        pairs = pairs.join(own, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return pairs.where("root_u <> root_v").select("u", "v", "root_u", "root_v")


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node, root) where the components that ``links`` (u, v) meet are one."""
    pairs = _apart(links, nodes).select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    tops = cut(components(pairs))
    if tops.isEmpty():
        return nodes
    alone = tops.join(nodes, "node", "left_anti").select("node", F.col("node").alias("root"))
    moved = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return cut(nodes.unionByName(alone).join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def one_of_each(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, miss: float = 1e-3, seed: int = 42
) -> DataFrame:
    """``docs`` with exactly one row of each component: of its smallest doc_id, or without one where all have none.

    Texts whose shingle sets have a Jaccard similarity of ``similarity`` or more are linked. Candidates
    agree on a block of their fingerprints and are near in its sketch; a pair right at ``similarity``
    shares no block with a chance of at most ``miss``. Among several rows of the smallest doc_id the one of the
    smallest hash of all columns stays.
    """
    bits, blocks, distance = plan(docs.count(), similarity, miss)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))  # whatever their names
    marks = _marks(width, bits, blocks, seed)("d.text")
    rows = own.withColumns({"row": F.monotonically_increasing_id(), "mark": marks})
    rows = cut(rows.select("d", "row", "mark.*"))
    classes = cut(rows.groupBy("ck").agg(F.min("row").alias("node"), *[F.first(c).alias(c) for c in ("keys", "s0", "s1")]))
    nodes = _Texts(rows.select("row", "d.text"), classes, similarity, width, distance, seed).components()
    named = classes.join(nodes, "node", "left").select("ck", F.coalesce("root", "node").alias("root"))
    # a hash of the whole row, for rows may share a doc_id or have none; row parts only rows equal in all columns
    id_of = F.col("d.doc_id")
    first = F.min(F.struct(id_of.isNull().alias("none"), id_of.alias("id"), F.xxhash64("d").alias("hash"), "row"))
    firsts = rows.groupBy("ck").agg(first.alias("first"))
    stays = named.join(firsts, "ck").groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return rows.join(stays, "row", "left_semi").select("d.*")
