"""A corpus pipeline of five stages over ``documents``: toxic, near-duplicate, repeated and leaked text goes, the rest is packed.

Defined cases: NULL and empty texts pass the first four stages and are packed as their end id; rows with
a NULL doc_id pass them too, unless their text is toxic or leaked; repeated rows are judged each, and
near-duplicate groups keep all rows of their least doc_id; texts of any length are judged whole; further
columns, whatever their names, are handed on to the last stage; empty documents give no rows, and empty
labels or benchmark let all documents pass their stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relift.llm import cdc, decontaminate, neardup, packing, toxicity
from relift.llm.common import scope, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; trained on all labelled documents of the stage's input."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate group stays (five words, 0.8)."""
    return neardup.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has are cut out; every document stays."""
    return cdc.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their sequences and places."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: SQL expresses neither the trained stage nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage writes for itself is removed when the stage's result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = stored(stage(spark, docs, sf_dir), name, lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
