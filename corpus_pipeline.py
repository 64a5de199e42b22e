"""The corpus pipeline: from the documents table to sampled token sequences.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All stages
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealis.llm.common import cut, documents
from arealis.llm.lines import line_filter
from arealis.llm.mixing import mix_documents, placed_documents
from arealis.llm.neardup import drop_near_duplicates
from arealis.llm.pieces import encode_sampled
from arealis.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs are proven on the labels."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are equal or nearly equal to an earlier line."""
    return line_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources are interleaved."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text, as ids, with the slot and place of
    the mixture: files keep no order of rows, and places depend on the rows alone."""
    return encode_sampled(placed_documents(docs), k=2, digest=False, carry=("slot", "place"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


#: Sampling without replacement has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
