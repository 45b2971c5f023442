"""The corpus pipeline against a brute-force version, stage by stage, each on what the one before kept."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import awkward, docs, empty, text
from test_text_models import brute_contamination

import corpus_pipeline
from stepweave.llm import decontaminate, packing, simhash, toxicity

NO_LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, folder):
    r = random.Random(3)
    rows = [(i, text(i, 60)) for i in range(260)]
    toxic = [(300 + i, " ".join(w if r.random() < 0.9 else r.choice(["idiot", "moron", "scum"]) for w in text(300 + i, 60).split())) for i in range(60)]
    exact = [(400 + i, rows[i][1]) for i in range(20)] + [(420 + i, rows[5][1]) for i in range(20)]
    near = [(500 + i, " ".join(r.choice(text(500 + i).split()) if k % 33 == 9 else w for k, w in enumerate(rows[40 + i][1].split()))) for i in range(20)]
    items = [(i, text(900 + i, 25)) for i in range(5)]
    leaks = [(600 + i, f"{text(600 + i, 40)} {items[i % 5][1]}") for i in range(15)]
    odd = [(700, None), (701, ""), (None, text(701, 30)), (None, text(701, 30)), (3, rows[3][1]), (702, text(702, 5000))]
    every = rows + toxic + exact + near + leaks + odd
    docs(spark, every).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i, _ in rows[:150] + toxic[:40]], NO_LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return every, {i for i, _ in toxic}, items


def brute_exact(rows):
    first: dict = {}
    for i, t in rows:
        if None not in (i, t):
            first[t] = min(first.get(t, i), i)
    out = Counter((i, t) for i, t in rows if None in (i, t))
    return out + Counter((i, t) for t, i in first.items())


def brute_near(rows):
    own = [(i, t) for i, t in rows if t and i is not None]
    prints, full = simhash.fingerprint_column(pa.array([t for _, t in own]))
    assert full.all()
    close = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(2) <= simhash.MAX_DISTANCE
    group = [i for i, _ in own]
    for _ in own:
        group = [min(group[j] for j in np.flatnonzero(row)) for row in close]
    return Counter((i, t) for (i, t), g in zip(own, group) if i == g) + Counter((i, t) for i, t in rows if not t or i is None)


def test_stages_and_run_match_brute_force(spark, tmp_path):
    every, toxic, items = corpus(spark, str(tmp_path))
    now, frame = Counter(every), spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = frame.columns
    for (name, stage), expect in zip(corpus_pipeline.STAGES[:-1], (None, brute_exact, brute_near, None)):
        kept = stage(spark, frame, str(tmp_path))
        assert kept.columns == columns
        kept.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        found = Counter((r["doc_id"], r["text"]) for r in frame.collect())
        if name == "toxicity":
            gone = {i for i, _ in (now - found)}
            assert len(gone & toxic) >= 0.95 * len(toxic) and gone <= toxic
            scores = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs(spark, every), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r["doc_id"] is not None}
            assert gone == {i for i, bad in scores.items() if bad}
        elif name == "decontamination":
            rows = list(now.elements())
            bad = {d for d, *_ in brute_contamination([(k, t) for k, (_, t) in enumerate(rows)], items, decontaminate.NGRAM)}
            assert found == Counter(x for k, x in enumerate(rows) if k not in bad) and len(bad) == 15
        else:
            assert found == expect(list(now.elements())) and found != now
        now = found
    for bins in (corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        covered: Counter = Counter()
        for b in bins.collect():
            assert b["tokens"] <= packing.CAPACITY
            for p in b["pieces"]:
                covered.update((p["doc_id"], k) for k in range(p["start"], p["end"]))
        assert covered == Counter((i, k) for i, t in now.elements() for k in range(len((t or "").split())))


def test_stages_bear_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1), (None, None, None)], NO_LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = {"toxicity": 15, "exact_dedup": 11, "near_dedup": 13, "decontamination": 15}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, awkward(spark), str(tmp_path))
        assert kept.columns == awkward(spark).columns and kept.count() == expected[name]
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), str(tmp_path)).count() == 0
