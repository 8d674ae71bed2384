"""Documents to packed training sequences, in five stages.

Each stage takes all rows that the one before it kept and returns the columns of ``documents``; the last returns the packed pieces. Between
stages the rows are written as Parquet and read again. Null and empty texts pass the quality stage (nothing speaks against
them), are linked with nothing, have nothing to cut, contain no benchmark item and are packed as an end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm.common import table
from vigil.llm.decontaminate import uncontaminated
from vigil.llm.jaccard import one_of_each
from vigil.llm.pack import pack
from vigil.llm.radix import without_repeats
from vigil.llm.resample import resample
from vigil.streaming.storage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to those labelled as good."""
    return resample(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that stand in an earlier one."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 1,024 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL has no tokenizer and no sampling by such a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), "stage")
    return STAGES[-1][1](spark, rows, sf_dir)
