"""Corpus pipeline: toxicity, quality, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``docs``; the last returns one row
per packed piece. :func:`run` writes each stage's rows to the shared folder and
rereads them as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaique.llm import line_dedup, packing, quality, simhash, toxicity
from mosaique.llm.common import cut, held_out


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of at least 0.5 go."""
    model = toxicity.fit(docs, _labels(spark, sf_dir), held_out("doc_id", 5, 0))
    return docs.where(toxicity.scorer(model)["score"] < 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below 0.7 go."""
    model = quality.fit(docs, _labels(spark, sf_dir), held_out("doc_id", 4, 2))
    return docs.where(quality.scorer(docs, model) >= 0.7)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that 3 documents share stay in the last of them alone."""
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("line_dedup", drop_common_lines),
    ("simhash", drop_near_copies),
    ("packing", pack),
]

#: The classifiers and the packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        rows = cut(stage(spark, rows, sf_dir))
    return rows
