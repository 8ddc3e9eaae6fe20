"""The corpus pipeline: five stages, each of which works on what the one before it kept.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run`` writes each result
as Parquet in the cluster's shared folder and rereads it as the next stage's documents, and deletes
these once the last stage is written. All stages but the last return the columns of ``documents``.

Nulls, empty texts, repeated rows and empty tables pass through every stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, line_dedup, ngram_join, packing, quality
from plumbline.session import scratch, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.fit_quality(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match earlier lines, short ones too; one that loses every word goes.

    ``n_chars`` counts the text that is left.
    """
    return line_dedup.keep_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are similar by 0.8 or more: the one of the smallest id."""
    return ngram_join.keep_first(docs, n=5, num=4, den=5)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: The quality network and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for _, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir))
        return stored(STAGES[-1][1](spark, docs, sf_dir))
