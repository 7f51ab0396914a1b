"""A corpus pipeline of this library's operators: each stage's documents are written, and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from manyfold.llm import langid, mixing, neardup, packing, quality_lm
from manyfold.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text finds likely enough for their language."""
    return quality_lm.trusted_alike(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    return langid.identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8."""
    return neardup.deduplicated(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words: one row per piece of a document."""
    return packing.packed(docs)


STAGES = [("quality classifier", quality), ("language ID", language), ("MinHash near-dedup", near_dedup), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: A language model, a kernel classifier and a greedy packer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
