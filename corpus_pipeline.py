"""The corpus pipeline: toxic documents, exact copies, near copies and contaminated documents go, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame; run()
writes each as Parquet and reads it again for the next. All but the last return the columns of documents.

Every stage bears nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any name.
Rows without text pass all stages but packing, which has nothing to pack of them. Rows without doc_id can't be kept apart by
the two deduplicating stages, which keep them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import decontaminate, lsm, packing, simhash, toxicity
from stepweave.llm.common import table
from stepweave.session import shared_dir


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on docs and the labels, doesn't reject; each row by its own text."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows of one text that with the smallest doc_id, of its repetitions one."""
    return lsm.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; repeated rows of it stay."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no token window with the benchmark; each row by its own text."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of all tokens of docs."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("packing", packed)]

#: The classifier, SimHash and packing have no SQL; tests/llm/test_pipeline.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
