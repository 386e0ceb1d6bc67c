"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality rules drop documents that they reject; SimHash keeps the smallest id of each group; decontamination drops documents
that hold a benchmark item; mixing repeats or drops documents to meet the sources' targets; token files end it. All stages but
the last return the columns of documents. Null texts fail the quality rules; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.common import delete_stored, stored, table
from foliospark.llm.decontaminate import decontaminated
from foliospark.llm.mixing import mixture
from foliospark.llm.quality_rules import keep_good
from foliospark.llm.queries import byte_bpe_path
from foliospark.llm.simhash import one_of_each
from foliospark.llm.token_files import token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs, byte_bpe_path())


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixing), ("token files", tokens)]

#: Hashes, networks and the tokenizer are beyond SQL: tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table of documents after all stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        if k:
            delete_stored(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
