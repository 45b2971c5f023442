"""Rows that every operator must bear."""

from __future__ import annotations

import random

WORDS = "alder birch cedar dune ember fjord grove heath inlet juniper kelp lagoon meadow nettle orchid prairie quarry ridge spruce tundra umber valley willow yarrow zephyr".split()
#: Columns whose names operators use inside.
CLASHING = "high low of_id of_high of_low loser bad spans several new keeper copies rep root kept block size left start g k weight pattern score toxic doc_key hash key f0 bin_id tokens chunk shard"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING.split())


def text(seed: int, words: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(words))


def docs(spark, rows):
    """rows: (doc_id, text)."""
    full = [(i, t, "en", None, None, *(["x"] * len(CLASHING.split()))) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    long = text(1, 30_000)
    rows = [(1, "short text"), (1, "short text"), (2, "short text"), (3, ""), (4, ""), (5, "  \n\t "), (6, None), (6, None), (None, "short text"), (None, None), (7, long), (8, long), (9, "a"), (10, "ñandú 日本語 \U0001f600"), (11, "!!! ???")]
    return docs(spark, rows)


def empty(spark):
    return docs(spark, [])
