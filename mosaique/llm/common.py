"""Helpers shared by the corpus operators.

:func:`bucket_units` and :func:`in_units` turn buckets of any size into units of
bounded size, so that all pairs of a bucket are compared without a task ever
holding a whole hot bucket. Shared files and components of links come from
:mod:`mosaique.operators.graph`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaique.operators.graph import components, cut, drop_cut, shared_dir
from mosaique.operators.kernel import components as labels_of

__all__ = [
    "BLOCK", "bucket_units", "components", "cut", "drop_cut", "held_out", "hot_units", "in_unit_batches", "in_units",
    "labelled_sample", "labels_of", "shared_dir",
]

#: Rows of one block of a bucket; a unit holds two blocks at most.
BLOCK = 1024


def bucket_units(rows: DataFrame, keys: list[str], node: str, block: int = BLOCK) -> DataFrame:
    """Deal bucketed rows into units: adds ``blk``, ``lo`` and ``hi``; single rows of a bucket go.

    A bucket of at most ``block`` rows is one unit. A larger one is dealt into
    blocks by a hash of ``node``, and each pair of blocks is a unit of its own.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    dealt = (
        rows.join(sizes, keys)
        .withColumn("_b", blocks)
        .withColumn("blk", F.pmod(F.xxhash64(node, F.lit(7)), F.col("_b")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    )
    return dealt.select(
        *rows.columns,
        "blk",
        F.least("blk", "_o").alias("lo"),
        F.greatest("blk", "_o").alias("hi"),
    )


def hot_units(rows: DataFrame, keys: list[str], node: str, block: int = BLOCK) -> DataFrame:
    """As :func:`bucket_units`, but single rows stay, and rows are joined only where some bucket needs blocks."""
    hot = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block))
    if hot.isEmpty():
        zero = F.lit(0)
        return rows.withColumns({"blk": zero, "lo": zero, "hi": zero})
    blocks = F.coalesce(F.ceil(F.col("_n") / F.lit(block)), F.lit(1)).cast("int")
    dealt = (
        rows.join(hot, keys, "left")
        .withColumn("_b", blocks)
        .withColumn("blk", F.pmod(F.xxhash64(node, F.lit(7)), F.col("_b")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    )
    return dealt.select(*rows.columns, "blk", F.least("blk", "_o").alias("lo"), F.greatest("blk", "_o").alias("hi"))


def _cuts(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin."""
    change = np.zeros(len(batch), dtype=bool)
    change[:1] = True
    for k in keys:
        x = batch[k].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def in_unit_batches(units: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """As :func:`in_units`, but ``work`` gets many whole units at once, by ``node``, and for each row the end of its unit."""
    by = [*keys, "lo", "hi"]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
            ends = np.append(starts[1:], len(frame))
            out = work(frame, np.repeat(ends, ends - starts))
            if out is not None:
                yield out

        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            starts = _cuts(batch, by)
            if len(starts) > 1:
                yield from done(batch.iloc[: starts[-1]], starts[:-1])
            held = batch.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield from done(held, np.zeros(1, np.int64))

    # in the order of nodes, so that units with the same nodes give the same links
    return units.repartition(*by).sortWithinPartitions(*by, "node").mapInPandas(over, schema)


def unit_frames(
    keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None]
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over rows sorted by ``keys``: calls ``work`` on each run of equal keys."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            cuts = _cuts(batch, keys).tolist()
            out = [work(batch.iloc[a:b]) for a, b in zip(cuts, cuts[1:])]
            out = [x for x in out if x is not None]
            if out:
                yield pd.concat(out, ignore_index=True)
            held = batch.iloc[cuts[-1] :]
        if held is not None and len(held):
            out = work(held)
            if out is not None:
                yield out

    return over


def in_units(units: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """Run ``work`` on each unit of :func:`bucket_units`."""
    by = [*keys, "lo", "hi"]
    return (
        units.repartition(*by).sortWithinPartitions(*by).mapInPandas(unit_frames(by, work), schema)
    )


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == part


def labelled_sample(labels: DataFrame, target: str, out: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids (doc_id, y), held-out ones left out, in the order of a hash of the id.

    A repeated id takes its largest label; null ids and labels are left out.
    """
    return (
        labels.select("doc_id", F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~out)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
