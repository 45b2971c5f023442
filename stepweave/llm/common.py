"""What the operators of this subpackage share: tables, written intermediate results and Arrow scans."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.session import ready, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The frame, computed once into the shared folder: no lineage is left, so a lost executor costs no recomputation,
    and what reads it knows its size."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over each Arrow batch of the frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle of this session feeds."""
    return max(int(ready(spark).conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def smallest(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The n distinct rows of columns with the smallest hash of them, all if there are fewer: a sample that depends on the
    rows alone. What can't be among them is left out in the scan; only some n rows meet in a task."""
    some = df.select(*columns)
    order = F.xxhash64(*columns)
    distinct = some.agg(F.approx_count_distinct(order, 0.02)).first()[0]
    share = min(1.0, (3.0 * n + 200) / max(distinct, 1))
    if share < 1:
        # three times as many distinct rows are expected, so that fewer than n pass is out of question
        some = some.where(order < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return some.distinct().orderBy(order, *columns).limit(n)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as a long and text as a string, whatever else the frame holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of the frame has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
