"""Connected components, and how iterated operators keep their lineage short.

:func:`cut` writes a frame to the folder all executors share and reads it back,
so later jobs neither recompute it nor depend on any one executor.
:func:`components` alternates large-star and small-star rounds (Kiveris et al.,
2014), each an aggregation and an equi-join.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests), one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="mosaique-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # type: ignore[attr-defined]
    return out


def cut_wide(df: DataFrame) -> DataFrame:
    """:func:`cut` of a table that grows with the raster: its joins shuffle and sort.

    Spark goes by the size of files, which compress; what it would broadcast for that can exceed the driver's memory.
    """
    out = cut(df)
    wide = out.hint("merge")
    wide._cut_path = out._cut_path  # type: ignore[attr-defined]
    return wide


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut` that nothing will read again."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): one row (node, root) per node of an edge.

    ``root`` is the smallest node of the component. Self-loops, repeated edges and
    edges in either direction are allowed. Spark may split the partition of a hub
    in the joins.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now, seen = _written(
        edges.where(u != v)
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u").where(v > u).select(v.alias("u"), F.least(u, m).alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(v == m, u).otherwise(v).alias("u"), m.alias("v"))
            .distinct()
        )
        before = seen
        new, seen = _written(small)
        drop_cut(now)
        now = new
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(u.alias("node"), v.alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """:func:`cut`, and the number of rows and sums of their hashes, taken by the same job."""
    h, seen = F.xxhash64("u", "v"), Observation()
    sums = F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")
    out = cut(edges.observe(seen, *sums))
    return out, tuple(seen.get[k] for k in ("n", "x", "s"))
