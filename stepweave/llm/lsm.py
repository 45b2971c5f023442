"""Exact duplicates by a log-structured merge index.

Digests (128 bits) are partitioned by digest. Each partition is an index of its own: records fill a memtable, a full
memtable is flushed as a run sorted by digest with a Bloom filter, runs of a level are compacted into one of the next
level, and compaction keeps the smallest identifier. A digest met before is found through the filters and a binary
search of the runs that they let through. Documents whose digest was met more than once are hits; hits are compared
byte by byte before one counts as a copy, so equal digests of unequal texts do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import free, partitions, scan, table, written
from stepweave.llm.textscan import mix

MEMTABLE_ROWS, FANOUT, FILTER_BITS, PROBES = 1 << 16, 8, 16, 4
#: Records of a partition of the index, whose runs are in memory.
PARTITION_ROWS = 1 << 21


def _order(high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, low, high))


@dataclass
class Run:
    """Digests in order, each once, with the smallest identifier and the number of records, and a filter over them."""

    high: np.ndarray
    low: np.ndarray
    ids: np.ndarray
    copies: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> Run:
        by = _order(high, low, ids)
        high, low, ids, copies = high[by], low[by], ids[by], copies[by]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(new)
        copies = np.add.reduceat(copies, at) if len(at) else copies
        bits = np.zeros(1 << max(6, int(len(at) * FILTER_BITS - 1).bit_length()), bool)
        for p in _probes(high[at], low[at], len(bits)):
            bits[p] = True
        return cls(high[at], low[at], ids[at], copies, np.packbits(bits))

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of each digest in the run, -1 where it isn't."""
        out = np.full(len(high), -1, np.int64)
        maybe = np.ones(len(high), bool)
        for p in _probes(high, low, len(self.filter) * 8):
            maybe &= (self.filter[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        some = np.flatnonzero(maybe)
        at = np.searchsorted(self.high, high[some])
        # equal first halves of unequal digests are rare, so a second step is
        while len(some):
            there = at < len(self.high)
            some, at = some[there], at[there]
            same = self.high[at] == high[some]
            some, at = some[same], at[same]
            hit = self.low[at] == low[some]
            out[some[hit]] = at[hit]
            some, at = some[~hit], at[~hit] + 1
        return out


def _probes(high: np.ndarray, low: np.ndarray, size: int) -> Iterator[np.ndarray]:
    step = mix(low.copy()) | np.uint64(1)
    for k in range(PROBES):
        yield ((high + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


class LsmIndex:
    """A log-structured merge index of one partition's digests."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.memtable_rows, self.fanout = memtable_rows, fanout
        self.memtable: list[tuple[np.ndarray, ...]] = []
        self.rows = 0
        self.levels: list[list[Run]] = []

    def add(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        self.memtable.append((high, low, ids, copies))
        self.rows += len(high)
        if self.rows >= self.memtable_rows:
            self.flush()

    def flush(self) -> None:
        """Sorts the memtable into a run. Digests that older runs hold are merged there, so runs stay disjoint."""
        if not self.rows:
            return
        run = Run.of(*(np.concatenate(x) for x in zip(*self.memtable)))
        self.memtable, self.rows = [], 0
        fresh = np.ones(len(run.high), bool)
        for older in (r for level in self.levels for r in level):
            at = older.find(run.high, run.low)
            hit = np.flatnonzero(at >= 0)
            older.ids[at[hit]] = np.minimum(older.ids[at[hit]], run.ids[hit])
            older.copies[at[hit]] += run.copies[hit]
            fresh[hit] = False
        if fresh.any():
            self._place(run if fresh.all() else Run.of(run.high[fresh], run.low[fresh], run.ids[fresh], run.copies[fresh]), 0)

    def _place(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._place(self._merge(runs), level + 1)

    @staticmethod
    def _merge(runs: list[Run]) -> Run:
        return Run.of(*(np.concatenate([getattr(r, k) for r in runs]) for k in ("high", "low", "ids", "copies")))

    def compact(self) -> Run | None:
        """Everything as one run."""
        self.flush()
        runs = [r for level in self.levels for r in level]
        return (runs[0] if len(runs) == 1 else self._merge(runs)) if runs else None


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    high, low, ids, copies = (np.array(batch.column(i)) for i in range(4))
    return high.view(np.uint64), low.view(np.uint64), ids, copies


def _batch(run: Run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (run.high.view(np.int64), run.low.view(np.int64), run.ids, run.copies)], ["high", "low", "doc_id", "copies"])


def digests(docs: DataFrame, high: str = "high", low: str = "low") -> DataFrame:
    """docs with the 128-bit digest of the text's bytes in two columns, null for a null text or doc_id."""
    text = F.when(F.col("doc_id").isNotNull(), F.col("text").cast("string"))
    return docs.withColumns({high: F.when(text.isNotNull(), F.xxhash64(text)), low: F.when(text.isNotNull(), F.xxhash64(F.lit(1), text))})


def build_index(entries: DataFrame) -> DataFrame:
    """(high, low, doc_id, copies) with one row for each digest of entries (high, low, doc_id, copies): the smallest
    doc_id and the number of records. Indexes can be merged by building one of their union.

    A task's records of one digest are merged before they are sent, a batch at a time, so a frequent one fills no
    partition; there are as many partitions as hold PARTITION_ROWS records each."""

    def merge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield _batch(Run.of(*_columns(batch)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LsmIndex()
        for b in batches:
            index.add(*_columns(b))
        if (done := index.compact()) is not None:
            yield _batch(done)

    schema = "high long, low long, doc_id long, copies long"
    rows = entries.where(F.col("high").isNotNull()).select("high", "low", F.col("doc_id").cast("long"), F.col("copies").cast("long"))
    parts = max(partitions(entries.sparkSession), -(-rows.count() // PARTITION_ROWS))
    return scan(rows, merge, schema).repartition(parts, "high", "low").mapInArrow(run, schema)


def _verified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests of all documents, and (doc_id, high, low, keeper, copies) of the copies and their keepers after comparing
    bytes: copies is the number of rows with that doc_id and text."""
    base = digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    entries = written(base.select("doc_id", "high", "low"))
    index = build_index(entries.withColumn("copies", F.lit(1)))
    hits = written(index.where("copies > 1").select("high", "low"))
    found = written(base.join(hits, ["high", "low"]).groupBy("high", "low", "text", "doc_id").agg(F.count("*").alias("copies")))
    keepers = found.groupBy("high", "low", "text").agg(F.min("doc_id").alias("keeper"))
    same = found.join(keepers, ["high", "low", "text"]).select("doc_id", "high", "low", "keeper", "copies")
    return entries, written(same)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keeper_id, duplicate) for each row of docs (doc_id, text, anything else).

    keeper_id is the smallest doc_id with the same text, byte for byte; duplicate says that it is another. The empty
    text is a text like others. A null text is no copy of anything; a null doc_id has a null keeper_id and takes no
    part. Repeated rows repeat in the result."""
    entries, same = _verified(docs)
    joined = entries.join(same.select("doc_id", "high", "low", "keeper"), ["doc_id", "high", "low"], "left")
    keeper = F.coalesce("keeper", "doc_id")
    return joined.select("doc_id", keeper.alias("keeper_id"), F.coalesce(keeper != F.col("doc_id"), F.lit(False)).alias("duplicate"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without copies: of rows with one text that with the smallest doc_id, and one of
    rows that repeat doc_id and text, that with the smallest hash of all columns. Rows with a null text or doc_id stay."""
    _, same = _verified(docs)
    high, low, of_id, of_high, of_low = free(docs, "high", "low", "of_id", "of_high", "of_low")
    keyed = digests(docs, high, low)
    key = (keyed["doc_id"].cast("long") == F.col(of_id)) & (F.col(high) == F.col(of_high)) & (F.col(low) == F.col(of_low))
    marks = same.select(F.col("doc_id").alias(of_id), F.col("high").alias(of_high), F.col("low").alias(of_low), F.expr("doc_id = keeper").alias("first"), F.expr("copies > 1").alias("again"))
    names = [of_id, of_high, of_low]
    kept = keyed.join(marks.where("not first or again").select(*names), key, "left_anti").select(*docs.columns)
    repeated = marks.where("first and again").select(*names)
    if repeated.isEmpty():
        return kept
    # rows are merged before they are moved, so many repetitions of one row are no burden
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = keyed.join(repeated, key, "left_semi").groupBy("doc_id", high, low).agg(F.min_by(row, F.xxhash64(F.to_json(row, {"ignoreNullFields": "false"}))).alias(of_id))
    return kept.unionByName(once.select(f"{of_id}.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_duplicates of every document."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id,
       CASE WHEN doc_id IS NULL OR text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keeper_id,
       coalesce(text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text), false) AS duplicate
FROM documents
"""
