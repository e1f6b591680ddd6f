"""Corpus pipeline: quality, line deduplication, near-duplicates, decontamination, packing.

Every stage works on all rows that the one before kept and is written as Parquet in the shared folder before the
next reads it, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratigraph.llm.decontaminate import drop_contaminated
from stratigraph.llm.linededup import drop_repeated_lines
from stratigraph.llm.packing import pack
from stratigraph.llm.quality import drop_bad
from stratigraph.llm.simhash import near_dedup
from stratigraph.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field holds for good. Null and empty texts are scored as one empty line; an empty table stays empty."""
    return drop_bad(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows without repeated lines. Null texts stay null; a document may end up with an empty text."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near texts. Rows of equal or null doc_id are one only if their texts are near."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay; documents that share a doc_id go together."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows. A null or empty text is its end id alone."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Trained scores and token ids cannot be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
