"""Vectorised scanning of Arrow text columns: tokens, token hashes and Rabin-Karp window hashes.

Everything works on the UTF-8 bytes of a column, a few megabytes at a time, with no loop over characters, tokens or
documents. A null text is an empty text. Hashes depend on the token's bytes alone, so they agree between partitions,
runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_BYTE_BASE, _TOKEN_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Separators of tokens: ASCII white space, or every ASCII character but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: One arbitrary 64-bit value for each byte, the same everywhere.
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * len(have) if have is not None else 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _segments(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[s:e] for each s, e, independent of s."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((total[ends] - total[starts]) * inverse[starts])


@dataclass
class Tokens:
    """Tokens of a run of documents. first[d]:first[d+1] are those of document d; start and end are byte offsets
    within the document's text, raw are the bytes of all texts and at the offsets of the tokens in them."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    raw: np.ndarray
    at: np.ndarray

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the first n bytes of every longer token, and that token's index."""
        long = np.flatnonzero(self.end - self.start > n)
        return _segments(_BYTES[self.raw], self.at[long], self.at[long] + n, _BYTE_BASE), long

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window of n tokens inside one document, and the index of its first token."""
        at = window_starts(self.first, n)
        return _segments(mix(self.hash), at, at + n, _TOKEN_BASE), at


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Indexes at which n tokens follow within the same document."""
    lengths = np.maximum(np.diff(first) - n + 1, 0)
    before = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(before[-1]) + np.repeat(first[:-1] - before[:-1], lengths)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values in them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def normalise(column: pa.Array) -> pa.Array:
    """Lower case, with each run of characters that are neither letters nor digits made one space."""
    return pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{N}]+", " ")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes, one row at least."""
    _, off = text_buffers(column)
    row, n = 0, len(column)
    while row < n:
        to = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, min(to, n)
        row = min(to, n)


def tokens(column: pa.Array, separators: np.ndarray = SPACE) -> Tokens:
    """The tokens between separators of each document of a chunk."""
    raw, off = text_buffers(column)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~separators[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    hashes = _segments(_BYTES[raw], start, end, _BYTE_BASE) if len(raw) else np.zeros(0, np.uint64)
    first = np.searchsorted(start, off).astype(np.int64)
    base = np.repeat(off[:-1], np.diff(first))
    return Tokens(hashes, start - base, end - base, first, raw, start)


def sequences(found: Tokens) -> np.ndarray:
    """One hash for the whole token sequence of each document."""
    return _segments(mix(found.hash), found.first[:-1], found.first[1:], _TOKEN_BASE)


def hash_tokens(words: list[str]) -> np.ndarray:
    """The hashes that tokens() gives to these tokens."""
    return tokens(pa.array(words)).hash if words else np.zeros(0, np.uint64)


def groups_sum(values: np.ndarray, first: np.ndarray, dtype: type = np.int64) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]], 0 for an empty range."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=dtype)
    return out


def sign_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each range of hashes (see Tokens.first) the bits that more than half of them have set, as uint64.

    Eight counters of one byte ride in each machine word, so ranges are summed in pieces of at most 255 hashes."""
    docs, lengths = len(first) - 1, np.diff(first)
    pieces = (lengths + 254) // 255
    piece_first = np.concatenate([[0], np.cumsum(pieces)])
    starts = np.repeat(first[:-1], pieces) + 255 * (np.arange(piece_first[-1]) - np.repeat(piece_first[:-1], pieces))
    out = np.zeros(docs, np.uint64)
    if not len(starts):
        return out
    for k in range(8):
        lanes = np.add.reduceat((hashes[: first[-1]] >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        counts = groups_sum(lanes.view(np.uint8).reshape(-1, 8), piece_first)
        for lane in range(8):
            out |= (2 * counts[:, lane] > lengths).astype(np.uint64) << np.uint64(8 * lane + k)
    return out
