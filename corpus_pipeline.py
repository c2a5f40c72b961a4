"""From documents to packed token sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and is written as Parquet and read again before the next.  Stages find
the columns they need by exact name and hand on all columns as they are,
whatever the others are called; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Sealed, read, scratch
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import pack, pieces
from tidemark.llm.quality_rules import measured
from tidemark.llm.shingle_dedup import deduplicate_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet every quality rule.

    Null and empty texts have no words and go; null ids and repeated rows stay
    if their texts pass.
    """
    table = Sealed(docs, text="text")
    return measured(table.df).where("q_kept").select(*table.open())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 0.8 alike or more.

    The smallest id stays, null ids last; rows with that id are told apart by
    the hash of their text, then by that of the whole row, so repeated rows
    leave one.  Null and empty texts are alike.
    """
    return deduplicate_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: one row for each pass that takes words of it.

    Documents without words take nothing; a null source is a source of its
    own; repeated rows are streams' parts of their own.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place.

    Null and empty texts are the end id alone; null ids are kept; repeated
    rows are pieces of their own.
    """
    return pack(pieces(docs))


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Packing, mixing and MinHash have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns goes to the shared folder."""
    folder = scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
