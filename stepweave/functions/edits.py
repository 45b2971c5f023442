"""Edit distances of many pairs of texts at once, by bit vectors (Myers, in Hyyrö's blocks).

64 rows of the table of a pair are one word. A word needs that above it one column earlier, so at each step all words of all
pairs advance, each one column behind the one above. Time and memory are those of words, not of cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that advance together: as many as the processor's cache holds.
WORDS = 4096
#: Entries of the table of matches of such a batch.
ENTRIES = 1 << 21
_ONE, _TOP, _ALL = np.uint64(1), np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points one after another, where each text begins, and its length."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size, size


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for each i."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Each code's place among the different ones, and how many these are."""
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    place = np.cumsum(there) - 1
    return place[codes], int(place[-1]) + 1


def _batch(rows: np.ndarray, columns: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distances of pairs of m codes (rows, one pair after another) and n codes (columns). None is empty."""
    words = -(-m // 64)
    first = np.cumsum(words) - words
    total = int(words.sum())
    level = _ranges(np.zeros(len(m), np.int64), words)
    pair = np.repeat(np.arange(len(m)), words)
    of, width = _numbered(np.concatenate([rows, columns]))
    at = _ranges(np.zeros(len(m), np.int64), m)
    matches = np.zeros(total * width, np.uint64)
    np.bitwise_or.at(matches, (np.repeat(first, m) + (at >> 6)) * width + of[: len(rows)], _ONE << (at & 63).astype(np.uint64))
    # so that words ahead of their pair's text, or done with it, read some code
    pad = int(words.max()) + 1
    steps = int((n + words).max())
    column = np.concatenate([np.zeros(pad, np.int64), of[len(rows) :], np.zeros(steps, np.int64)])
    begin = (np.cumsum(n) - n)[pair] + pad - level
    base = np.arange(total) * width
    rise, fall = np.full(total, _ALL), np.zeros(total, np.uint64)
    # what the word above hands down: that its last row went up or down; above the first the table goes up by one each column
    up, down = np.zeros(total + 1, np.uint64), np.zeros(total + 1, np.uint64)
    p, q, up_out, down_out = up[:-1], down[:-1], up[1:], down[1:]
    place, code, eq, xv, ph, mh = np.empty(total, np.int64), np.empty(total, np.int64), *(np.empty(total, np.uint64) for _ in range(4))
    of_pair = n[pair]
    end = of_pair + level - 1
    last = np.argsort(end, kind="stable")
    done_at = np.searchsorted(end[last], np.arange(steps + 1))
    by_level = np.argsort(level, kind="stable")
    begun_at = np.searchsorted(level[by_level], np.arange(steps + 1))
    kept_rise, kept_fall = np.empty(total, np.uint64), np.empty(total, np.uint64)
    for t in range(steps):
        if begun_at[t] < begun_at[t + 1]:
            fresh = by_level[begun_at[t] : begun_at[t + 1]]
            rise[fresh], fall[fresh] = _ALL, 0
        up[first], down[first] = 1, 0
        np.take(column, begin, out=code, mode="clip")
        np.add(base, code, out=place)
        np.take(matches, place, out=eq, mode="clip")
        np.bitwise_or(eq, fall, out=xv)
        np.bitwise_or(eq, q, out=eq)
        # xh, in place of eq: ((eq & rise) + rise ^ rise) | eq
        np.bitwise_and(eq, rise, out=mh)
        np.add(mh, rise, out=mh)
        np.bitwise_xor(mh, rise, out=mh)
        np.bitwise_or(eq, mh, out=eq)
        # ph = fall | ~(xh | rise), mh = rise & xh
        np.bitwise_or(eq, rise, out=ph)
        np.invert(ph, out=ph)
        np.bitwise_or(ph, fall, out=ph)
        np.bitwise_and(rise, eq, out=mh)
        # eq and rise: shifted, with what came from above, before that is replaced by what goes down
        np.left_shift(ph, _ONE, out=eq)
        np.bitwise_or(eq, p, out=eq)
        np.left_shift(mh, _ONE, out=rise)
        np.bitwise_or(rise, q, out=rise)
        np.right_shift(ph, _TOP, out=up_out)
        np.right_shift(mh, _TOP, out=down_out)
        # fall = ph & xv, rise = mh | ~(xv | ph)
        np.bitwise_and(eq, xv, out=fall)
        np.bitwise_or(xv, eq, out=xv)
        np.invert(xv, out=xv)
        np.bitwise_or(rise, xv, out=rise)
        begin += 1
        if done_at[t] < done_at[t + 1]:
            done = last[done_at[t] : done_at[t + 1]]
            kept_rise[done], kept_fall[done] = rise[done], fall[done]
    # of the last column: from its top, n, down to row m
    left = m[pair] - level * 64
    mask = np.where(left >= 64, _ALL, (_ONE << np.minimum(left, 63).astype(np.uint64)) - _ONE)
    change = np.bitwise_count(kept_rise & mask).astype(np.int64) - np.bitwise_count(kept_fall & mask).astype(np.int64)
    return n + np.add.reduceat(change, first)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """The Levenshtein distance of each text of a and the text of b in its place, by characters."""
    codes_a, at_a, size_a = _codes(a)
    codes_b, at_b, size_b = _codes(b)
    out = np.maximum(size_a, size_b)
    codes, at_b = np.concatenate([codes_a, codes_b]), at_b + len(codes_a)
    # the longer one in rows: fewer steps
    turned = size_a < size_b
    at_m, m, at_n, n = np.where(turned, at_b, at_a), np.maximum(size_a, size_b), np.where(turned, at_a, at_b), np.minimum(size_a, size_b)
    some = np.flatnonzero(n > 0)
    # pairs of about as many steps together
    some = some[np.argsort(n[some] + (-(-m[some] // 64)), kind="stable")]
    words = np.cumsum(-(-m[some] // 64))
    begin = 0
    while begin < len(some):
        before = words[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(words, before + WORDS, "right")))
        own = some[begin:stop]
        rows, columns = codes[_ranges(at_m[own], m[own])], codes[_ranges(at_n[own], n[own])]
        width = _numbered(np.concatenate([rows, columns]))[1]
        if len(own) > 1 and (words[stop - 1] - before) * width > ENTRIES:
            stop = max(begin + 1, int(np.searchsorted(words, before + max(1, ENTRIES // width), "right")))
            own = some[begin:stop]
            rows, columns = codes[_ranges(at_m[own], m[own])], codes[_ranges(at_n[own], n[own])]
        out[own] = _batch(rows, columns, m[own], n[own])
        begin = stop
    return out


def distance(a: str, b: str) -> Column:
    """Of the texts of two columns, neither of them null."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(distances(x.tolist(), y.tolist()).astype(np.int32))

    return run(a, b)


def similarity_from(edits: Column, x: Column, y: Column) -> Column:
    """As text.similarity_of, given the distance."""
    return F.when(x == y, 100.0).otherwise(F.bround((F.lit(1.0) - edits / F.greatest(F.length(x), F.length(y)).cast("double")) * 100, 1))
