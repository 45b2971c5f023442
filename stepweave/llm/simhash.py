"""Near-duplicate documents by SimHash and covering masks.

A fingerprint has BITS bits; bit i is what more than half of the document's content tokens have as bit i of their hash
(of few, one edit changes more bits than MAX_DISTANCE: short documents link when their tokens are the same).
It is split into parts, each with a dimension; the dimensions add up to MAX_DISTANCE + 1, so two fingerprints within
MAX_DISTANCE differ by fewer bits than the dimension in some part. Each bit of a part of dimension d has a vector of d bits;
a mask of the part, one for each vector v but 0, holds the bits whose vector has an odd product with v. Fewer than d
differing bits span less than all vectors, so some v has an even product with all of them: its mask holds none of them and
the two are equal under it. No pair is lost, and a mask holds half of the part, some 25 bits, so few others are equal.
Documents of equal fingerprint are one row before the search, so a group of thousands of copies costs no pairs; candidates
are verified by their Hamming distance, with no cap on partners. Groups need links, not all pairs: a task compares no two
fingerprints that it has linked already, directly or over others, and returns a link for each fingerprint, not for each pair.
Every two slices of SLICE fingerprints meet in a task, and few slices in several, which share the masks: up to SLICE
fingerprints each is sorted once by each mask, beyond that the sorting grows with the square of the slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import textscan as ts
from stepweave.llm.common import free, scan, table, texts, written
from stepweave.llm.graph import components
from stepweave.session import ready

BITS, MAX_DISTANCE = 256, 40
#: Tokens of fewer bytes are mostly function words, which any two documents of a language share.
MIN_TOKEN_BYTES = 4
#: A document of fewer content tokens is represented by all its tokens.
MIN_FEATURES = 8
#: Fingerprints of a slice, the least number of tasks, and candidates that are verified at once.
SLICE, TASKS, PAIRS = 1 << 19, 12, 1 << 20
WORDS = BITS // 64
_NAMES = [f"f{i}" for i in range(WORDS)]


def fingerprint_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (documents x WORDS) and which documents have any token."""
    tokens = ts.tokens(pc.utf8_lower(column), ts.PUNCTUATION)
    content = tokens.end - tokens.start >= MIN_TOKEN_BYTES
    few = ts.groups_sum(content, tokens.first) < MIN_FEATURES
    content |= np.repeat(few, np.diff(tokens.first))
    hashes, first = tokens.hash[content], np.concatenate([[0], np.cumsum(content)])[tokens.first]
    words = []
    for i in range(WORDS):
        seed = np.uint64((0xA0761D6478BD642F * (i + 1)) % (1 << 64))
        words.append(ts.sign_bits(ts.mix(hashes + seed), first))
    return np.stack(words, axis=1), np.diff(tokens.first) > 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, ...), null fingerprints for documents without tokens (null, empty or punctuation alone)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, column = batch.column(0), batch.column(1)
        for a, b in ts.chunks(column):
            words, full = fingerprint_column(column.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(words[:, i].view(np.int64), mask=~full) for i in range(WORDS))], ["doc_id", *_NAMES])

    return scan(texts(docs), run, "doc_id long, " + ", ".join(f"{n} long" for n in _NAMES))


def covers(rows: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, mask) of each part and mask; any two fingerprints within MAX_DISTANCE are equal under one of them.
    More rows get fewer parts: more masks, under which fewer fingerprints are equal."""
    parts = 8 if rows < 1 << 12 else 6 if rows < 1 << 16 else 5
    r, found = np.random.Generator(np.random.PCG64(40)), []
    for k in range(parts):
        dimension = (MAX_DISTANCE + 1) // parts + (k < (MAX_DISTANCE + 1) % parts)
        first, end = BITS * k // parts, BITS * (k + 1) // parts
        vectors = np.arange(1, 1 << dimension)
        # of random vectors for the bits, those of the fewest equal fingerprints; every choice covers
        tries = [r.permutation(np.resize(r.permutation(vectors), end - first)) for _ in range(100)]
        held = min(((np.bitwise_count(vectors[:, None] & t) & 1 for t in tries)), key=lambda h: (0.5 ** h.sum(1)).sum())
        found += [(first, end - first, sum(1 << b for b in np.flatnonzero(h).tolist())) for h in held]
    return found


def _part(words: list[np.ndarray], first: int, bits: int) -> np.ndarray:
    """Bits first to first + bits, 64 at most, of fingerprints given by column."""
    word, shift = divmod(first, 64)
    part = words[word] >> np.uint64(shift)
    if shift + bits > 64:
        part |= words[word + 1] << np.uint64(64 - shift)
    return part


def distances(words: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs i, j that are within MAX_DISTANCE, and their distances."""
    distance = np.zeros(len(i), np.int64)
    for w, column in enumerate(words):
        distance += np.bitwise_count(column[i] ^ column[j])
        if w:
            near = distance <= MAX_DISTANCE
            i, j, distance = i[near], j[near], distance[near]
    return i, j, distance


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of each component of 0 to n - 1 under links i, j."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, j, i)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _ends(starts: np.ndarray) -> np.ndarray:
    """For each place the end of its run; starts says where a run begins."""
    at = np.append(np.flatnonzero(starts), len(starts))
    return np.repeat(at[1:], np.diff(at))


def _candidates(keys: np.ndarray, low: int, root: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first partner and number of partners of each place of keys, sorted: partners follow it and have the same key but
    for the low bits, which are the row; with root none of its own component, whose rows follow one another."""
    rows, keys = (keys & np.uint64((1 << low) - 1)).astype(np.int64), keys >> np.uint64(low)
    new = np.append(True, keys[1:] != keys[:-1])
    ends = _ends(new)
    first = np.arange(1, len(rows) + 1) if root is None else _ends(new | np.append(True, root[rows[1:]] != root[rows[:-1]]))
    return rows, first, ends - first


def _meet(words: np.ndarray, side: np.ndarray, masks: list[tuple[int, int, int]], found: Callable, root: np.ndarray | None) -> None:
    """Calls found(i, j, distance) for rows of words (fingerprints x WORDS) within MAX_DISTANCE that are equal under one of the
    masks; where side has both True and False, for pairs of the two alone. What found returns is None, or how rows are
    numbered from there on and the root of each, by which components follow one another."""
    columns = [np.ascontiguousarray(words[:, w]) for w in range(WORDS)]
    low, both = max(1, (len(words) - 1).bit_length()), side.any() and not side.all()
    last = np.uint64((1 << low) - 1)
    for first, bits, mask in masks:
        keys = (_part(columns, first, bits) & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) & ~last | np.arange(len(words), dtype=np.uint64)
        keys.sort()
        same = (keys[1:] ^ keys[:-1]) <= last
        todo = keys[np.append(same, False) | np.append(False, same)]
        while len(todo):
            rows, start, n = _candidates(todo, low, root)
            ends, at, moved = np.cumsum(n), 0, None
            while at < len(todo) and moved is None:
                # as many rows as make some PAIRS candidates, one at least
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                part = n[at:until]
                i = np.repeat(np.arange(at, until), part)
                j = np.arange(len(i)) + np.repeat(start[at:until] - (np.cumsum(part) - part), part)
                i, j = rows[i], rows[j]
                if both:
                    across = side[i] != side[j]
                    i, j = i[across], j[across]
                moved, at = found(*distances(columns, i, j)), until
            # a row before at has met all its partners; those after it meet each other by their new numbers
            todo = todo[at:]
            if moved is not None:
                order, root = moved
                columns, side = [c[order] for c in columns], side[order]
                place = np.empty(len(order), np.uint64)
                place[order] = np.arange(len(order), dtype=np.uint64)
                todo = np.sort(todo & ~last | place[(todo & last).astype(np.int64)])


def close_pairs(words: np.ndarray, side: np.ndarray, masks: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and distances of all pairs that _meet finds, each once."""
    kept, held = [np.zeros(0, np.int64)], 0

    def found(i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        nonlocal kept, held
        # 28 bits a row, 7 for the distance
        kept.append((np.minimum(i, j) << 35) + (np.maximum(i, j) << 7) + distance)
        held += len(i)
        if held > max(4 * PAIRS, 2 * len(kept[0])):
            kept, held = [np.unique(np.concatenate(kept))], 0

    _meet(words, side, masks, found, None)
    pairs = np.unique(np.concatenate(kept))
    return pairs >> 35, pairs >> 7 & ((1 << 28) - 1), pairs & 127


def close_links(words: np.ndarray, side: np.ndarray, masks: list[tuple[int, int, int]]) -> np.ndarray:
    """For each row one of its component, the same for all of it, under the pairs that _meet finds."""
    row, root, links, held = np.arange(len(words)), np.arange(len(words)), [], 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        nonlocal row, root, links, held
        i, j = (np.concatenate(c) for c in zip(*links))
        joined = roots(len(row), root[i], root[j])[root]
        order = np.argsort(joined, kind="stable")
        new = np.diff(joined[order], prepend=-1) != 0
        row, root, links, held = row[order], np.flatnonzero(new)[np.cumsum(new) - 1], [], 0
        return order, root

    def found(i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        nonlocal held
        if len(i):
            links.append((i, j))
            held += len(i)
        return merge() if held > 1000 + len(words) // 64 else None

    _meet(words, side, masks, found, root)
    if held:
        merge()
    out = np.empty(len(words), np.int64)
    out[row] = row[root]
    return out


def _tasks(prints: DataFrame, run: Callable[[np.ndarray, np.ndarray, np.ndarray, list], list[np.ndarray]], schema: pa.Schema) -> DataFrame:
    """Rows that run(rep, words, side, masks) makes wherever two slices of prints (rep, f0, ...) meet under some of the masks."""
    spark = ready(prints.sparkSession)
    rows = prints.count()
    slices = max(1, -(-rows // SLICE))
    shares = -(-TASKS // (slices * (slices + 1) // 2))
    masks = covers(rows if slices == 1 else 2 * rows // slices)
    own = F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("int")
    # the tasks of slices p <= q have the rows of both
    tasks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda o: F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda s: (F.least(o, own) * slices + F.greatest(o, own)) * shares + s)))
    spread = prints.select(F.explode(tasks).alias("task"), own.alias("slice"), "rep", *_NAMES)

    def task(found: pa.Table) -> pa.Table:
        at = found.column(0)[0].as_py()
        side = found.column(1).to_numpy() == at // shares % slices
        words = np.stack([found.column(3 + w).to_numpy().view(np.uint64) for w in range(WORDS)], 1)
        out = run(found.column(2).to_numpy(), words, side, masks[at % shares :: shares])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return spread.groupBy("task").applyInArrow(task, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema))


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b, distance), a < b, of all rows (rep, f0, ...) within MAX_DISTANCE, each pair once."""

    def run(rep: np.ndarray, words: np.ndarray, side: np.ndarray, masks: list) -> list[np.ndarray]:
        i, j, distance = close_pairs(words, side, masks)
        a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
        return [c[a < b] for c in (a, b, distance.astype(np.int32))]

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])
    return _tasks(prints, run, schema).groupBy("a", "b").agg(F.min("distance").alias("distance"))


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b) whose components are those of near_pairs; the two are linked, directly or over others. No more than a row for
    each row of a task, however many pairs there are."""

    def run(rep: np.ndarray, words: np.ndarray, side: np.ndarray, masks: list) -> list[np.ndarray]:
        other = rep[close_links(words, side, masks)]
        return [c[rep != other] for c in (rep, other)]

    return _tasks(prints, run, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, kept) for each row of docs (doc_id, text, anything else).

    group_id is the smallest doc_id among the documents that close pairs link, directly or over others; kept is true for
    that document alone. A document like no other is its own group. Null, empty and punctuation-only texts are alone
    too; a null doc_id has a null group and is kept. Rows of one doc_id that fall into several groups each have
    their row; repeated rows repeat in the result."""
    prints = written(fingerprints(docs))
    keyed = prints.where(F.col("f0").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(keyed.groupBy(*_NAMES).agg(F.min("doc_id").alias("rep")))
    # a doc_id with several texts stands for several fingerprints; pairs of those are the same document
    linked = components(near_links(reps))
    grouped = reps.join(linked, reps.rep == linked.node, "left").select(*_NAMES, F.coalesce("root", "rep").alias("root"))
    return prints.join(grouped, _NAMES, "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("group_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id near_duplicates keeps; rows that share a doc_id share its fate."""
    fate = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    (loser,) = free(docs, "loser")
    losers = fate.where("not kept").select(F.col("doc_id").alias(loser))
    return docs.join(losers, docs["doc_id"].cast("long") == F.col(loser), "left_anti")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
