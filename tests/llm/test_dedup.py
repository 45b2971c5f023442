"""Exact, near and substring duplicates against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import WORDS, awkward, docs, empty, text

from stepweave.llm import graph, lsm, simhash, substring


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_exact_duplicates_match_brute_force(spark):
    r = random.Random(3)
    rows = [(i, text(r.randrange(40), 8)) for i in range(200)]
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert table(lsm.exact_duplicates(docs(spark, rows)), "doc_id", "keeper_id", "duplicate") == sorted((i, first[t], first[t] != i) for i, t in rows)


def test_exact_duplicates_compare_bytes(spark, monkeypatch):
    real = lsm.digests

    def same(frame, high="high", low="low"):
        from pyspark.sql import functions as F

        full = real(frame, high, low)
        return full.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(7).cast("long")) for c in (high, low)})

    monkeypatch.setattr(lsm, "digests", same)
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    assert table(lsm.exact_duplicates(docs(spark, rows)), "doc_id", "keeper_id") == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_exact_edges(spark):
    found = Counter((r[0], r[1], r[2]) for r in lsm.exact_duplicates(awkward(spark)).collect())
    assert found[1, 1, False] == 2 and found[2, 1, True] == 1 and found[3, 3, False] == 1 and found[4, 3, True] == 1
    assert found[6, 6, False] == 2 and found[None, None, False] == 2 and found[8, 7, True] == 1
    assert lsm.exact_duplicates(empty(spark)).count() == 0


def test_keep_first(spark):
    kept = lsm.keep_first(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({1: 1, 3: 1, 5: 1, 6: 2, None: 2, 7: 1, 9: 1, 10: 1, 11: 1})
    assert lsm.keep_first(empty(spark)).count() == 0


def test_keep_first_of_rows_that_differ_elsewhere(spark):
    frame = spark.createDataFrame([(1, "a", f"s{i}") for i in range(20)] + [(2, "a", "t"), (3, None, "u")], "doc_id long, text string, source string")
    kept = [sorted(map(str, lsm.keep_first(f).collect())) for f in (frame, frame.orderBy("source"), frame.repartition(7))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def test_runs_tell_digests_of_one_half_apart():
    high, low = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 3, 1], np.uint64)
    run = lsm.Run.of(high, low, np.arange(4), np.ones(4, np.int64))
    assert run.find(np.array([5, 5, 9, 5, 4], np.uint64), np.array([3, 1, 1, 4, 1], np.uint64)).tolist() == [2, 0, 3, -1, -1]


def test_lsm_index_flushes_and_compacts():
    r = np.random.default_rng(0)
    index, expected = lsm.LsmIndex(memtable_rows=50, fanout=3), {}
    for _ in range(60):
        high, low, ids = r.integers(0, 300, 20).astype(np.uint64), r.integers(0, 2, 20).astype(np.uint64), r.integers(0, 10**6, 20)
        index.add(high, low, ids, np.ones(20, np.int64))
        for h, w, i in zip(high.tolist(), low.tolist(), ids.tolist()):
            smallest, n = expected.get((h, w), (i, 0))
            expected[h, w] = min(smallest, i), n + 1
    assert len([x for level in index.levels for x in level]) > 1
    done = index.compact()
    assert {(h, w): (i, n) for h, w, i, n in zip(done.high.tolist(), done.low.tolist(), done.ids.tolist(), done.copies.tolist())} == expected
    assert list(zip(done.high, done.low)) == sorted(zip(done.high, done.low))


def near_copy(t: str, r: random.Random, share: float = 0.03) -> str:
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in t.split())


def near_rows():
    r = random.Random(5)
    rows = []
    for k in range(60):
        base = text(1000 + k, 150)
        rows += [(10 * k, base), *((10 * k + j, near_copy(base, r)) for j in range(1, 4))]
    return rows + [(5000 + i, text(9000 + i, 120)) for i in range(100)]


def test_near_pairs_match_brute_force(spark):
    prints, full = simhash.fingerprint_column(pa.array([t for _, t in near_rows()]))
    assert full.all()
    distance = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(2)
    a, b = np.nonzero(np.triu(distance <= simhash.MAX_DISTANCE, 1))
    rows = [(i, *map(int, p.view(np.int64))) for i, p in enumerate(prints)]
    found = {(r["a"], r["b"]): r["distance"] for r in simhash.near_pairs(spark.createDataFrame(rows, "rep long, f0 long, f1 long, f2 long, f3 long")).collect()}
    true = {(x, y): int(distance[x, y]) for x, y in zip(a.tolist(), b.tolist())}
    assert found == true


def test_near_pairs_are_complete_at_every_distance(spark):
    r = np.random.default_rng(6)
    rows = []
    for d in range(simhash.MAX_DISTANCE + 3):
        for _ in range(12):
            bits = r.integers(0, 2, simhash.BITS)
            other = bits.copy()
            other[r.choice(simhash.BITS, d, replace=False)] ^= 1
            rows += [(len(rows), *np.packbits(b).view(np.int64).tolist()) for b in (bits,)]
            rows += [(len(rows), *np.packbits(b).view(np.int64).tolist()) for b in (other,)]
    found = Counter((x["a"], x["b"], x["distance"]) for x in simhash.near_pairs(spark.createDataFrame(rows, "rep long, f0 long, f1 long, f2 long, f3 long")).collect())
    assert found == Counter((2 * k, 2 * k + 1, k // 12) for k in range(12 * (simhash.MAX_DISTANCE + 1)))


@pytest.mark.parametrize("rows", [100, 1 << 14, 1 << 17])
def test_some_mask_holds_no_differing_bit(rows):
    r = np.random.default_rng(7)
    masks = np.zeros((0, simhash.BITS), bool)
    for first, bits, mask in simhash.covers(rows):
        masks = np.vstack([masks, np.zeros(simhash.BITS, bool)])
        masks[-1, first : first + bits] = [mask >> b & 1 for b in range(bits)]
    d = simhash.MAX_DISTANCE
    for k in range(300):
        # anywhere, next to each other, or in a part of the fingerprint
        bits = r.choice(simhash.BITS, d, False) if k % 3 == 0 else (np.arange(d) * (k % 5 + 1) + k) % simhash.BITS if k % 3 == 1 else r.choice(60, d, False) + k % 190
        assert (~masks[:, bits].any(1)).any()


def test_links_compare_few_fingerprints_and_no_pair_twice(monkeypatch):
    r = np.random.default_rng(8)
    words = r.integers(0, 1 << 64, (23_000, simhash.WORDS), dtype=np.uint64)
    # 3000 near copies of one, which are 4.5 million pairs
    words[-3000:] = words[0]
    words[-3000:, r.integers(0, simhash.WORDS)] ^= np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64)
    words[-3000:, 0] ^= r.integers(0, 1 << 12, 3000).astype(np.uint64)
    compared, real = [], simhash.distances
    monkeypatch.setattr(simhash, "distances", lambda w, i, j: compared.append(len(i)) or real(w, i, j))
    monkeypatch.setattr(simhash, "PAIRS", 1 << 14)
    found = simhash.close_links(words, np.ones(len(words), bool), simhash.covers(len(words)))
    component = np.flatnonzero(found == found[0])
    assert component.tolist() == [0, *range(20_000, 23_000)] and (found[1:20_000] == np.arange(1, 20_000)).all()
    assert sum(compared) < 20 * len(words)


def test_near_duplicates_over_several_slices(spark, monkeypatch):
    rows = near_rows()
    whole = table(simhash.near_duplicates(docs(spark, rows)), "doc_id", "group_id", "kept")
    prints = simhash.fingerprints(docs(spark, rows)).withColumnRenamed("doc_id", "rep").localCheckpoint()
    pairs = table(simhash.near_pairs(prints), "a", "b", "distance")
    monkeypatch.setattr(simhash, "SLICE", 100)
    assert table(simhash.near_duplicates(docs(spark, rows)), "doc_id", "group_id", "kept") == whole
    assert table(simhash.near_pairs(prints), "a", "b", "distance") == pairs


def test_near_duplicates_group_copies_and_leave_others(spark):
    found = {r["doc_id"]: (r["group_id"], r["kept"]) for r in simhash.near_duplicates(docs(spark, near_rows())).collect()}
    prints, _ = simhash.fingerprint_column(pa.array([t for _, t in near_rows()]))
    ids, close = [i for i, _ in near_rows()], np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(2) <= simhash.MAX_DISTANCE
    group = list(range(len(ids)))
    for _ in ids:  # the smallest of all that can be reached
        group = [min(group[j] for j in np.flatnonzero(row)) for row in close]
    assert found == {i: (ids[g], ids[g] == i) for i, g in zip(ids, group)}
    together = sum(found[10 * k + j][0] == 10 * k for k in range(60) for j in range(4))
    assert together >= 0.95 * 240
    assert all(found[5000 + i] == (5000 + i, True) for i in range(100))


def test_short_documents_link_by_all_their_tokens(spark):
    rows = [(1, "a b c d"), (2, "d c b a!"), (3, "a b c e"), (4, "of the cat"), (5, "on a cat"), (6, "one two three four five")]
    found = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_near_edges(spark):
    found = Counter(tuple(r) for r in simhash.near_duplicates(awkward(spark)).collect())
    assert found[1, 1, True] == 2 and found[2, 1, False] == 1 and found[8, 7, False] == 1
    assert all(found[i, i, True] for i in (3, 4, 5, 9, 10, 11)) and found[6, 6, True] == 2 and found[None, None, True] == 2
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, None, 7, 9, 10, 11}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (None, 3)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {row["node"]: row["root"] for row in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}


def brute_intervals(rows, n):
    windows = Counter()
    for _, t in rows:
        w = (t or "").split()
        windows.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for doc, t in rows:
        w, found = (t or "").split(), []
        for i in range(len(w) - n + 1):
            if windows[tuple(w[i : i + n])] > 1:
                if found and i <= found[-1][1]:
                    found[-1][1] = i + n
                else:
                    found.append([i, i + n])
        out += [(doc, a, b) for a, b in found]
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [3, 6])
def test_repeated_intervals_match_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 3000)
    r = random.Random(n)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(40)))) for i in range(120)] + [(500, None), (501, ""), (None, "a b c d e f g h a b"), (3, "a b c d e f g")]
    found = substring.repeated_intervals(docs(spark, rows), n)
    assert sorted(((x[0], x[2], x[3]) for x in found.collect()), key=str) == brute_intervals(rows, n)


def test_substring_edges(spark):
    found = Counter(tuple(r)[:1] + tuple(r)[2:] for r in substring.repeated_intervals(awkward(spark)).collect())
    assert found == Counter({(7, 0, 30_000): 1, (8, 0, 30_000): 1})
    assert substring.repeated_intervals(empty(spark)).count() == 0


def test_remove_repeats(spark):
    shared = text(77, 55)
    rows = [(1, f"start one\n{shared} end one "), (2, f"two {shared}"), (3, text(78, 60)), (4, None), (None, f"none {shared}")]
    out = substring.remove_repeats(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "start one end one ", 2: "two", 3: text(78, 60), 4: None, None: "none"}
