"""Which pairs of scenarios can have enough steps alike, by bounds on the lengths and letters of their texts.

Bounds never pass over a pair that the comparison would accept: similar texts have lengths in a ratio and differ in no more
letters than edits are allowed. Scenarios of one task are compared as whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LETTERS = 32
#: Elements of the largest arrays of a step.
CELLS = 1 << 22
FEATURES = "lengths binary, letters binary"
FOUND = "home string, x string, y string"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To the columns of batches, the last of which is a list of texts: in its place their lengths (int32) and counts of
    letters by code point, modulo LETTERS (uint8, 255 at most), longest text first."""
    for batch in batches:
        lengths, letters = [], []
        for texts in batch.column(batch.num_columns - 1).to_pylist():
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS
            of = np.repeat(np.arange(len(texts)), size) * LETTERS + codes
            counts = np.minimum(np.bincount(of, minlength=len(texts) * LETTERS), 255).astype(np.uint8).reshape(-1, LETTERS)
            order = np.argsort(-size, kind="stable")
            lengths.append(size[order].astype(np.int32).tobytes())
            letters.append(counts[order].tobytes())
        columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(lengths, pa.binary()), pa.array(letters, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lengths", "letters"])


def may_match(a: np.ndarray, b: np.ndarray, needed: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs of rows of a and b (lengths, longest first) in which needed texts may have partners, one each. With
    p texts of a row left out, the k-th of the rest lies between its k-th and its k+p-th."""
    p, q = a.shape[1] - needed, b.shape[1] - needed
    ok = np.ones((len(a), len(b)), bool)
    i = j = None
    for k in range(needed):
        low_a, high_a, low_b, high_b = a[:, k + p] * ratio, a[:, k], b[:, k + q] * ratio, b[:, k]
        if i is None:
            ok &= low_a[:, None] <= high_b[None, :]
            ok &= low_b[None, :] <= high_a[:, None]
            if np.count_nonzero(ok) * 8 < ok.size:
                i, j = np.nonzero(ok)
        else:
            keep = (low_a[i] <= high_b[j]) & (low_b[j] <= high_a[i])
            i, j = i[keep], j[keep]
    return np.nonzero(ok) if i is None else (i, j)


def may_be_alike(la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray, needed: int, ratio: float) -> np.ndarray:
    """Of pairs of scenarios (lengths, letters; pairs first) whether on both sides needed texts have one that they may match. The
    shortest texts, which letters tell apart best, come first, and what can't reach needed is looked at no more."""
    alive = np.arange(len(la))
    na, nb = la.shape[1], lb.shape[1]
    missed = np.zeros(len(la), np.int32)
    matched = np.zeros((len(la), nb), bool)
    for k in range(na - 1, -1, -1):
        x, y = la[alive, k].astype(np.float64)[:, None], lb[alive]
        most = np.maximum(x, y) * (1 - ratio)
        d = ha[alive, k].astype(np.int16)[:, None, :] - hb[alive]
        up = np.maximum(d, 0).sum(2, dtype=np.int32)
        down = up - d.sum(2, dtype=np.int32)
        ok = (np.maximum(up, down) <= most) & (np.minimum(x, y) >= np.maximum(x, y) * ratio)
        matched[alive] |= ok
        missed[alive] += ~ok.any(1)
        alive = alive[missed[alive] <= na - needed]
        if not len(alive):
            break
    good = np.zeros(len(la), bool)
    good[alive] = matched[alive].sum(1) >= needed
    return good


def candidates(share: float, near: float):
    """A function of the scenarios of two parts (kind, n, side: 0 x, 1 y, 2 both, lengths, letters) that gives the pairs x, y that
    may have share percent of the smaller's steps equal or similar by near percent. Of one part each pair comes once."""
    ratio = min(near, 100.0) / 100 - 0.0006

    def pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        side, n, kind = t["side"].to_numpy(), t["n"].to_numpy(), np.array(t["kind"].to_pylist(), object)
        own = [np.flatnonzero(side != 1), np.flatnonzero(side != 0)]
        if not len(own[0]) or not len(own[1]):
            return
        same = bool((side == 2).any())
        sizes, letters = [], []
        for at in own:
            sizes.append(np.stack([np.frombuffer(v, np.int32) for v in t["lengths"].take(at).to_pylist()]))
            letters.append(np.stack([np.frombuffer(v, np.uint8) for v in t["letters"].take(at).to_pylist()]).reshape(len(at), -1, LETTERS))
        na, nb = int(n[own[0][0]]), int(n[own[1][0]])
        needed = max(0, int(np.ceil(min(na, nb) * ((share - 0.06) / 100) - 1e-9)))
        if needed > min(na, nb):
            return
        i, j = may_match(sizes[0], sizes[1], needed, ratio)
        if same:
            i, j = i[i < j], j[i < j]
        step = max(1, CELLS // (max(na, nb) * LETTERS))
        for at in range(0, len(i), step):
            x, y = i[at : at + step], j[at : at + step]
            good = may_be_alike(sizes[0][x], letters[0][x], sizes[1][y], letters[1][y], needed, ratio)
            yield kind[own[0]][x[good]], kind[own[1]][y[good]]

    def run(t: pa.Table) -> pa.Table:
        found = list(pairs(t))
        x, y = (np.concatenate([f[k] for f in found]) if found else [] for k in (0, 1))
        columns = [pa.array([t["home"][0].as_py()] * len(x), pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string())]
        return pa.Table.from_arrays(columns, names=["home", "x", "y"])

    return run
