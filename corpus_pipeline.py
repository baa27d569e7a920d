"""The corpus pipeline: quality, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame; all but the last return the columns of
`documents`. run() writes each stage's rows to the shared folder and reads them
again, so a stage never computes an earlier one twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicwright.llm.common import bounded_batches, materialise, table_parts
from topicwright.llm.decontaminate import clean_rows
from topicwright.llm.kneser_ney import train
from topicwright.llm.packing import pack_documents
from topicwright.llm.parity_join import keep_one
from topicwright.llm.queries import WORD_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity isn't over their language's threshold."""
    return train(docs, table_parts(spark, sf_dir, "labels")).accepted()


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: the one with the least doc_id."""
    bounded_batches(spark)
    return keep_one(docs, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean_rows(docs, table_parts(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    bounded_batches(spark)
    return pack_documents(docs, WORD_BPE, capacity=4096, end_id=1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: No stage but the first parts of the second can be told in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table_parts(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
