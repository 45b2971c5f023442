"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams against every token window.

Texts are normalised (lower case, runs of anything but letters and digits are one space). Every window of NGRAM tokens
of every document is hashed and looked up; hits are verified token by token. Items of fewer tokens are looked for as
a whole, down to MIN_TOKENS; shorter ones match only a document that consists of them. A benchmark of more than SLICE_BYTES
of text is taken in slices of whole items, one scan each, so what is broadcast is bounded (but for one item, all of whose
texts stay together) and nothing is left out. Rows are judged by their own text where they are read: no row is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import textscan as ts
from stepweave.llm.common import free, scan, table, texts

NGRAM, MIN_TOKENS, SLICE_BYTES = 13, 5, 8 << 20
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_TABLE_BITS = 20
SCHEMA = "doc_id long, item_id long, windows long, first_token long, end_token long, tokens long, spans array<struct<start:long,end:long>>"


class GramSet:
    """The n-grams of some benchmark items: by length, sorted hashes behind a table of their top bits, and the tokens."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.grams: dict[str, list[int]] = {}
        lengths: dict[int, set[str]] = {}
        self.whole: dict[str, list[int]] = {}
        normal = ts.normalise(pa.array([t for _, t in items], pa.string())).to_pylist() if items else []
        for (item, _), text in zip(items, normal):
            words = text.split()
            if 0 < len(words) < MIN_TOKENS:
                self.whole.setdefault(" ".join(words), []).append(item)
            elif words:
                k = min(n, len(words))
                for gram in {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}:
                    self.grams.setdefault(gram, []).append(item)
                    lengths.setdefault(k, set()).add(gram)
        self.sorted, self.table = {}, {}
        for k, grams in lengths.items():
            hashes = np.sort(ts.tokens(pa.array(sorted(grams), pa.string())).windows(k)[0])
            self.sorted[k] = hashes
            self.table[k] = np.zeros(1 << _TABLE_BITS, bool)
            self.table[k][(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.whole_hashes = np.sort(ts.sequences(ts.tokens(pa.array(sorted(self.whole), pa.string()))))

    def hits(self, tokens: ts.Tokens) -> dict[int, list[tuple[int, int]]]:
        """By document, (first token, number of tokens) of windows whose hash is in the set."""
        out: dict[int, list[tuple[int, int]]] = {}
        for k, hashes in self.sorted.items():
            windows, at = tokens.windows(k)
            some = np.flatnonzero(self.table[k][(windows >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            found = windows[some]
            some = some[hashes[np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)] == found]
            token = at[some]
            for doc, pos in zip((np.searchsorted(tokens.first, token, "right") - 1).tolist(), token.tolist()):
                out.setdefault(doc, []).append((pos - int(tokens.first[doc]), k))
        if len(self.whole_hashes):
            count = np.diff(tokens.first)
            short = np.flatnonzero((count > 0) & (count < MIN_TOKENS))
            for doc in short[np.isin(ts.sequences(tokens)[short], self.whole_hashes)].tolist():
                out.setdefault(doc, []).append((0, int(count[doc])))
        return out

    def items(self, gram: str, whole: bool) -> list[int]:
        """The items that have these tokens: the verification of a hit."""
        return self.grams.get(gram, []) + (self.whole.get(gram, []) if whole else [])


def _rows(doc_id: int | None, text: str, normal: str, hits: list[tuple[int, int]], grams: GramSet) -> Iterator[tuple]:
    words = normal.split()
    by_item: dict[int, set[tuple[int, int]]] = {}
    for pos, k in hits:
        for item in grams.items(" ".join(words[pos : pos + k]), k == len(words)):
            by_item.setdefault(item, set()).add((pos, pos + k))
    if not by_item:
        return
    at = [m.span() for m in _WORD.finditer(pc.utf8_lower(pa.scalar(text)).as_py())]
    for item, windows in sorted(by_item.items()):
        merged: list[list[int]] = []
        for a, b in sorted(windows):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        yield doc_id, item, len(windows), merged[0][0], max(b for _, b in merged), len(words), [{"start": at[a][0], "end": at[b - 1][1]} for a, b in merged]


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The whole benchmark in lists of about SLICE_BYTES of text, an item's texts in one of them."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // SLICE_BYTES)
    for k in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()]


def _found(grams: GramSet, column: pa.Array, ids: pa.Array) -> Iterator[tuple[int, list[tuple]]]:
    """(row, its rows of contamination) of each text of a column that shares a window."""
    for a, b in ts.chunks(column):
        original = column.slice(a, b - a)
        normal = ts.normalise(original)
        for d, hits in sorted(grams.hits(ts.tokens(normal)).items()):
            if rows := list(_rows(ids[a + d].as_py(), original[d].as_py(), normal[d].as_py(), hits, grams)):
                yield a + d, rows


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """A row for each document and benchmark item that share a window: how many windows, the first and the end token of
    what they cover (in the document's normalised tokens), the document's number of tokens, and the covered character
    spans of the original text.

    Documents without a shared window have no row. Null and empty texts and items share nothing; a null doc_id is
    carried; items without an item_id are left out; a repeated row has its rows again; several texts of one item_id
    are one item."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("windows", pa.int64()), ("first_token", pa.int64()), ("end_token", pa.int64()), ("tokens", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    spark, parts = docs.sparkSession, []
    for items in _slices(benchmark):
        shared = spark.sparkContext.broadcast(GramSet(items, n))

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            rows = [r for _, own in _found(shared.value, batch.column(1), batch.column(0)) for r in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

        parts.append(scan(texts(docs), run, SCHEMA))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], SCHEMA)


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """The rows of docs, all columns, whose own text shares no window with the benchmark, whatever their doc_id. Rows without
    text stay."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")
    for items in _slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(GramSet(items, n))

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            keep = np.ones(len(batch), bool)
            keep[[row for row, _ in _found(shared.value, batch.column(at), pa.nulls(len(batch), pa.int64()))]] = False
            yield batch.filter(pa.array(keep))

        docs = scan(docs, run, docs.schema)
    return docs


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """The rows of docs, all columns, their texts without the spans that they share with the benchmark; each row by its own
    text. Rows without text stay as they are."""
    spans, new = free(docs, "spans", "new")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    marked = docs.withColumn("text", F.col("text").cast("string")).withColumn(spans, F.array().cast("array<struct<start:long,end:long>>"))
    at, columns = docs.columns.index("text"), docs.columns
    for items in _slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(GramSet(items, n))

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            own = batch.column(len(columns)).to_pylist()
            for row, rows in _found(shared.value, batch.column(at), pa.nulls(len(batch), pa.int64())):
                own[row] += [span for r in rows for span in r[6]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(own, kind)], [*columns, spans])

        marked = scan(marked, run, marked.schema)
    text = F.col("text")

    def step(done, span):
        more = F.when(span["start"] > done["at"], F.concat(done["text"], F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")))).otherwise(done["text"])
        return F.struct(more.alias("text"), F.greatest(done["at"], span["end"]).alias("at"))

    done = F.aggregate(F.array_sort(spans), F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")), step)
    cut = F.when(F.size(spans) == 0, text).otherwise(F.concat(done["text"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))
    return marked.withColumn(new, cut).select(*(F.col(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination of every document by every benchmark item, without the spans."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP9_SQL = rf"""
WITH doc AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' ') AS w FROM documents WHERE text IS NOT NULL
), item AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' ') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL
), gram AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least({NGRAM}, len(w)) AS k, unnest(range(1, len(w) - least({NGRAM}, len(w)) + 2)) AS i FROM item WHERE len(w) >= {MIN_TOKENS})
), size AS (SELECT DISTINCT k FROM gram),
shown AS (
  SELECT doc_id, tokens, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, len(w) AS tokens, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)
)
SELECT doc_id, item_id, count(*) AS windows, min(i) - 1 AS first_token, max(i + shown.k) - 1 AS end_token, any_value(tokens)::BIGINT AS tokens
FROM shown JOIN gram ON gram.k = shown.k AND gram.g = shown.g GROUP BY doc_id, item_id
"""
