"""Repeated passages by Rabin-Karp hashes of every window of WINDOW white-space tokens.

A task hashes all windows of a chunk of documents and sends each hash to the bucket of its top bits, as packed arrays: 8
bytes of hash and 2 of position, not a row, for each window. A bucket's task sorts its hashes; those that
occur more than once go back to their chunk, where overlapping and touching windows merge into maximal intervals. Nothing
is broadcast and no window is sampled. There are as many buckets as keep one at BUCKET_BYTES of text, whatever the input.
A hash has 64 bits: of n windows some n * n / 2 ** 65 differ from all others and still count as repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import textscan as ts
from stepweave.llm.common import free, partitions, table

WINDOW, CHUNK_BYTES, BUCKET_BYTES = 50, 8 << 20, 32 << 20
_MESSAGE = pa.schema([("to", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_MESSAGE_SQL = "to int, chunk long, kind int, a binary, b binary, c binary"
_INTERVALS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start_token", pa.int64()), ("end_token", pa.int64())])
_DIRECTORY, _HASHES, _REPEATED = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _MESSAGE.types)], schema=_MESSAGE)


def _send(n: int, buckets: int):
    """(doc_id, key, text) -> the windows of each chunk by bucket, and the chunk's directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        for batch in batches:
            ids, keys, column = batch.column(0), batch.column(1), batch.column(2)
            for a, b in ts.chunks(column, CHUNK_BYTES):
                counts, hashes = [np.zeros(1, np.int64)], []
                part = column.slice(a, b - a)
                for x, y in ts.chunks(part):
                    tokens = ts.tokens(part.slice(x, y - x))
                    hashes.append(tokens.windows(n)[0])
                    counts.append(np.maximum(np.diff(tokens.first) - n + 1, 0))
                windows = np.concatenate(hashes)
                if not len(windows):
                    continue
                first = np.cumsum(np.concatenate(counts))
                own = ids.slice(a, b - a)
                names = np.array(own.fill_null(0)).tobytes() + np.packbits(np.array(own.is_valid().to_numpy(zero_copy_only=False))).tobytes()
                rows = [(chunk % buckets, chunk, _DIRECTORY, names, np.array(keys.slice(a, b - a).fill_null(0)).tobytes(), first.tobytes())]
                bucket = ((windows >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    at = by[edges[k] : edges[k + 1]]
                    step = np.diff(at, prepend=0)
                    rows.append((k, chunk, _HASHES, windows[at].tobytes(), step.astype(np.uint16 if step.max() < 1 << 16 else np.uint32).tobytes(), None))
                chunk += 1
                yield _batch(rows)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All messages of a bucket -> the repeated windows of each chunk, and the directories."""
    hashes, steps, chunks = [], [], []
    for batch in batches:
        rows = batch.to_pydict()
        keep = []
        for chunk, kind, a, b, c in zip(rows["chunk"], rows["kind"], rows["a"], rows["b"], rows["c"]):
            if kind == _DIRECTORY:
                keep.append((0, chunk, kind, a, b, c))
            else:
                hashes.append(np.frombuffer(a, np.uint64))
                steps.append(b)
                chunks.append(chunk)
        if keep:
            yield _batch(keep)
    if not hashes:
        return
    every = np.concatenate(hashes)
    by = np.argsort(every)
    ordered = every[by]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(every), bool)
    again[by[1:][same]] = True
    again[by[:-1][same]] = True
    del every, by, ordered, same
    start = 0
    for own, step, chunk in zip(hashes, steps, chunks):
        here = again[start : start + len(own)]
        start += len(own)
        if here.any():
            at = np.cumsum(np.frombuffer(step, np.uint16 if len(step) == 2 * len(own) else np.uint32), dtype=np.int64)
            yield _batch([(0, chunk, _REPEATED, at[here].astype(np.uint32).tobytes(), None, None)])


def merge(doc: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals (document, start, end) of windows of n tokens, given in order of document and start."""
    if not len(doc):
        return doc, start, start
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], start[last] + n


def _intervals(n: int):
    """Messages of whole chunks -> intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory: dict[int, tuple[bytes, bytes, bytes]] = {}
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            rows = batch.to_pydict()
            for chunk, kind, a, b, c in zip(rows["chunk"], rows["kind"], rows["a"], rows["b"], rows["c"]):
                if kind == _DIRECTORY:
                    directory[chunk] = a, b, c
                else:
                    found.setdefault(chunk, []).append(np.frombuffer(a, np.uint32))
        for chunk, parts in found.items():
            names, keys, first = directory[chunk]
            first = np.frombuffer(first, np.int64)
            docs = len(first) - 1
            windows = np.sort(np.concatenate(parts)).astype(np.int64)
            doc = np.searchsorted(first, windows, "right") - 1
            doc, start, end = merge(doc, windows - first[doc], n)
            ids = np.frombuffer(names[: 8 * docs], np.int64)
            valid = np.unpackbits(np.frombuffer(names[8 * docs :], np.uint8))[:docs].astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc], mask=~valid[doc]), pa.array(np.frombuffer(keys, np.int64)[doc]), pa.array(start), pa.array(end)], schema=_INTERVALS)

    return run


def repeated_intervals(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start_token, end_token): the maximal intervals of a document's white-space tokens that windows of
    n tokens occurring more than once, in other documents or the same, cover.

    Windows are equal when the 64-bit hashes of their tokens are. A text of fewer than n tokens, null or empty has none. A null
    doc_id is carried; repeated rows repeat each other's windows, and each has its intervals. text_key is a hash of the
    text, to tell rows that share a doc_id apart."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    sent = rows.mapInArrow(_send(n, buckets), _MESSAGE_SQL)
    counted = sent.repartitionById(buckets, "to").mapInArrow(_count, _MESSAGE_SQL)
    return counted.repartition(buckets, "chunk").mapInArrow(_intervals(n), "doc_id long, text_key long, start_token long, end_token long")


def remove_repeats(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, with the tokens of repeated_intervals cut from their texts, the white space before
    each cut token too. A row with a null doc_id is cut like others."""
    of_id, of_key, spans, new = free(docs, "of_id", "of_key", "spans", "new")
    found = repeated_intervals(docs, n).distinct().groupBy(F.col("doc_id").alias(of_id), F.col("text_key").alias(of_key)).agg(F.array_sort(F.collect_list(F.struct("start_token", "end_token"))).alias(spans))
    text = F.col("text").cast("string")
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_key)), "left")
    # a token with the white space before it; the white space after the last token stays
    pieces = F.regexp_extract_all(text, F.lit(r"[ \t\n\r\f\x0B]*[^ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (i >= s["start_token"]) & (i < s["end_token"])))
    cut = F.when(F.col(spans).isNull(), text).otherwise(F.array_join(kept, ""))
    return joined.withColumn(new, cut).select(*(F.col(new).alias("text") if c == "text" else docs[c] for c in docs.columns))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated_intervals of every document."""
    return repeated_intervals(table(spark, sf_dir, "documents")).drop("text_key")


OP2_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), shown AS (
  SELECT r, doc_id, i - 1 AS i, md5(array_to_string(w[i : i + {WINDOW} - 1], ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM doc WHERE len(w) >= {WINDOW})
), again AS (
  SELECT r, doc_id, i FROM shown WHERE g IN (SELECT g FROM shown GROUP BY g HAVING count(*) > 1)
), marked AS (
  SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {WINDOW} THEN 1 ELSE 0 END AS new FROM again
), island AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM marked)
SELECT any_value(doc_id) AS doc_id, min(i) AS start_token, max(i) + {WINDOW} AS end_token FROM island GROUP BY r, k
"""
