"""Token counts of whole texts, without making the tokens.

A unigram vocabulary's best segmentation is found by dynamic programming over the matches that an Aho-Corasick automaton
enumerates; a position carries only the best score and the number of pieces that reach it. Ties go as in the
tokenizer's library: scores are summed from the text's beginning in 32-bit floats, below REBASE they start from 0 again, and the match that
begins first wins.

No piece holds a word boundary inside, so a word's search needs of the text before it only the score there, and a word
met before is looked up: its pieces' scores, and the coarsest rounding that surely leaves every choice on its best path as
it is. Where a text's running score rounds coarser than that, the word is searched anew from the very score.

The public vocabulary files are byte-pair encodings. as_unigram makes a unigram model of such a file, whose pieces it lists
by their frequency: a piece's score is minus the logarithm of its place, as by Zipf's law.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import textscan as ts
from stepweave.llm.common import scan, table, texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words remembered by a worker; the memory is emptied when full, which changes no count.
REMEMBERED = 1 << 20
#: Characters of the longest word that is remembered.
LONG = 256
#: The library takes a position's score off all open ones when it is less.
REBASE = np.float32(-100_000)
#: Words of a text that are looked at together.
WINDOW = 1024
#: Words whose paths are found together.
LEARNT = 1 << 13
#: Bytes of text whose words are looked up together.
CHUNK_BYTES = 8 << 20
SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NORMAL, _USER_DEFINED, _UNIGRAM = 1, 4, 1
_NONE, _INFINITE = float("-inf"), float("inf")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _field(number: int, value: int | bytes) -> bytes:
    def varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def as_unigram(proto: bytes) -> bytes:
    """A unigram model's file as it is; of any other a unigram model of its pieces, with scores by their order."""
    trainer = next((dict(_message(v)) for n, v in _message(proto) if n == 2), {})
    if trainer.get(3, _UNIGRAM) == _UNIGRAM:
        return proto
    out, place = [_field(2, _field(3, _UNIGRAM) + _field(35, trainer.get(35, 0)))], 0
    for number, value in _message(proto):
        if number == 1:
            piece = dict(_message(value))
            place += 1
            out.append(_field(1, _field(1, piece[1]) + b"\x15" + np.float32(-np.log(place)).tobytes() + _field(3, piece.get(3, _NORMAL))))
        elif number != 2:
            out.append(_field(number, value))
    return b"".join(out)


@dataclass
class Paths:
    """Best paths of words: pieces, score, the rounding below which every choice holds, and below which the number of pieces
    does (equals of as many pieces may then take each other's place), the largest score met; how many scores of the
    path are in scores, in order."""

    pieces: np.ndarray
    sums: np.ndarray
    holds: np.ndarray
    counts_hold: np.ndarray
    reach: np.ndarray
    lengths: np.ndarray
    scores: np.ndarray

    def of(self, ids: np.ndarray) -> Paths:
        """Those of some words, without scores."""
        return Paths(self.pieces[ids], self.sums[ids], self.holds[ids], self.counts_hold[ids], self.reach[ids], self.lengths[ids], self.scores[:0])

    @classmethod
    def joined(cls, parts: list[Paths]) -> Paths:
        return cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))


@dataclass
class Vocabulary:
    """The pieces and scores of a model file, and how it treats unknown characters and spaces."""

    proto: bytes
    scores: dict[str, float] = field(default_factory=dict)
    byte_fallback: bool = False
    dummy_prefix: bool = True
    plain: bool = True

    def __post_init__(self) -> None:
        user: list[str] = []
        for number, value in _message(self.proto):
            if number == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for n, v in _message(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, np.float32)[0])
                    elif n == 3:
                        kind = v
                if kind == _NORMAL:
                    self.scores[piece] = score
                elif kind == _USER_DEFINED:
                    user.append(piece)
            elif number == 2:
                self.byte_fallback = bool(dict(_message(value)).get(35, 0))
            elif number == 3:
                spec = dict(_message(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                self.plain = not spec.get(2) and not spec.get(4, 1) and bool(spec.get(5, 1))
        scores = np.array(list(self.scores.values()), np.float32)
        self.unknown = np.min(scores, initial=np.float32(3.4028235e38)) - np.float32(10)
        #: all scores are multiples of this
        mantissa, exponent = np.frexp(scores[scores != 0])
        whole = np.abs(mantissa * 2.0**24).astype(np.int64)
        self.grain = float(np.min((whole & -whole) * 2.0 ** (exponent - 24), initial=_INFINITE))
        #: user-defined pieces, which the library's bonus makes win; it is added in 64 bits and 32 of the sum are kept
        high = np.max(scores, initial=np.float32(1.17549435e-38))
        self.bonus = {p: np.float64(np.float32(len(p.encode())) * high) - 0.1 for p in user}
        pieces = self.scores | self.bonus
        # a run of unknown characters is one piece, and must not go on in the next word
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces) and (self.byte_fallback or SPACE in pieces)
        self.automaton = ahocorasick.Automaton()
        #: by piece: characters, score as it is added, score in 64 bits
        self.lengths, self.added = [len(p) for p in pieces], [x if p in self.bonus else np.float32(x) for p, x in pieces.items()]
        self.spans = np.array([*self.lengths, 1], np.int64)
        self.exact = np.array([*pieces.values(), self.unknown], np.float64)
        for k, piece in enumerate(pieces):
            self.automaton.add_word(piece, k)
        self.some, self.longest = bool(pieces), max(self.lengths, default=0)
        if pieces:
            self.automaton.make_automaton()
        characters = {p for p in pieces if len(p) == 1}
        self.strange = re.compile(f"[^{re.escape(''.join(sorted(characters)))}]" if characters else "(?s:.)")
        #: a character of no piece
        self.separator = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not any(c in p for p in pieces))

    def paths(self, words: list[str]) -> Paths:
        """The words' best paths from score 0 in exact sums, all words at once from position to position.

        Matches of an end come longest first, so the first of equals is kept; an unknown character comes last."""
        sizes = np.array([len(w) for w in words], np.int64)
        origin = np.cumsum(sizes + 1) - sizes - 1
        joined, unknown = self.separator.join(words), len(self.lengths)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)) if self.some else (), np.int64).reshape(-1, 2)
        strange = np.array([m.start() for m in self.strange.finditer(joined)], np.int64)
        is_strange = np.zeros(len(joined) + 1, bool)
        is_strange[strange] = True
        is_strange[origin[1:] - 1] = False
        strange = np.flatnonzero(is_strange)
        # nodes are positions in the joined words; a word's first node is its origin
        at = np.searchsorted(found[:, 0], strange, "right")
        end, piece = np.insert(found[:, 0], at, strange) + 1, np.insert(found[:, 1], at, unknown)
        origin_of = np.repeat(origin, sizes + 1)
        by = np.argsort((end - origin_of[end - 1]).astype(np.int16), kind="stable")
        end, piece = end[by], piece[by]
        start, depth = end - self.spans[piece], end - origin_of[end - 1]
        value = self.exact[piece]
        if self.byte_fallback:
            size_of = np.zeros(len(joined) + 1, np.int64)
            size_of[strange] = [len(joined[i].encode("utf-8", "surrogatepass")) for i in strange.tolist()]
        nodes = len(joined) + 1
        best, via, most, count = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        holds, counts_hold = np.full(nodes, _INFINITE), np.full(nodes, _INFINITE)
        last_strange = np.zeros(nodes, bool)
        candidates = np.zeros(len(end))
        edges = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if a == b:
                continue
            s, e, odd = start[a:b], end[a:b], piece[a:b] == unknown
            at = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, b - a)))
            c = candidates[a:b] = best[s] + value[a:b]
            n = count[s] + np.where(odd, size_of[s] if self.byte_fallback else ~last_strange[s], 1)
            top = np.maximum.reduceat(c, at)
            first = np.minimum.reduceat(np.where(c == top[group], np.arange(b - a), b - a), at)
            k = np.maximum.reduceat(most[s], at) + 1
            behind = top[group] - c
            behind[first] = _INFINITE
            # a sum of k scores is off by k half roundings at most
            gap = np.minimum.reduceat(behind, at) / k
            behind[(behind == 0) & (n == n[first][group])] = _INFINITE
            node, before = e[at], s[first]
            best[node], via[node], most[node], count[node] = top, a + first, k, n[first]
            last_strange[node] = odd[first]
            holds[node] = np.minimum(gap, holds[before])
            counts_hold[node] = np.minimum(np.minimum.reduceat(behind, at) / k, counts_hold[before])
        last = origin + sizes
        reach = np.zeros(nodes)
        if len(end):
            by = np.argsort(end, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(end[by]) != 0))
            reach[end[by][at]] = np.maximum.reduceat(np.abs(candidates[by]), at)
        reach = np.maximum.reduceat(reach, origin) if len(words) else reach[:0]
        # back from the ends of all words at once
        steps, node = [], last.copy()
        while (open_ := np.flatnonzero(node > origin)).size:
            m = via[node[open_]]
            steps.append((open_, value[m]))
            node[open_] = start[m]
        word = np.concatenate([w for w, _ in reversed(steps)]) if steps else np.zeros(0, np.int64)
        scores = np.concatenate([v for _, v in reversed(steps)]) if steps else np.zeros(0)
        by = np.argsort(word, kind="stable")
        return Paths(count[last], best[last], holds[last], counts_hold[last], reach, np.bincount(word, minlength=len(words)), scores[by].astype(np.float32))

    def search(self, text: str, score: np.float32 = np.float32(0)) -> tuple[int, np.float32]:
        """Pieces of the best segmentation of a text whose spaces are SPACE, and its score, begun at score: in 32-bit floats,
        with unknown characters."""
        n = len(text)
        at_start: list[list[int]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(text) if self.some else ():
            at_start[end + 1 - self.lengths[piece]].append(piece)
        score_to: list = [score] + [None] * n
        pieces, unknown = [0] * (n + 1), [False] * (n + 1)
        for start in range(n):
            here, single = score_to[start], False
            if here < REBASE:
                for end in range(start + 1, min(start + self.longest, n + 1)):
                    if score_to[end] is not None:
                        score_to[end] = np.float32(score_to[end] - here)
                here = np.float32(0)
            for piece in at_start[start]:
                end, candidate = start + self.lengths[piece], here + self.added[piece]
                single |= end == start + 1
                if score_to[end] is None or candidate > score_to[end]:
                    score_to[end], pieces[end], unknown[end] = np.float32(candidate), pieces[start] + 1, False
            if not single:
                end, candidate = start + 1, here + self.unknown
                if score_to[end] is None or candidate > score_to[end]:
                    size = len(text[start].encode()) if self.byte_fallback else 0 if unknown[start] else 1
                    score_to[end], pieces[end], unknown[end] = candidate, pieces[start] + size, True
        return pieces[n], score_to[n]


@lru_cache(maxsize=2)
def _counter(proto: bytes) -> Counter:
    return Counter(proto)


class Counter:
    """Counts of texts by a vocabulary, remembering words."""

    def __init__(self, proto: bytes, remembered: int = REMEMBERED):
        self.vocabulary = Vocabulary(proto)
        self.library = None if self.vocabulary.plain else sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        #: by word, its place in the paths
        self.known: dict[str, int] = {}
        self.paths = self.vocabulary.paths([])
        self.first = np.zeros(1, np.int64)

    def normal(self, text: str | None) -> str:
        """The text as the library sees it, its spaces SPACE."""
        if not text:
            return ""
        if self.vocabulary.plain:
            return (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE)
        return self.library.normalize(text)

    def _learn(self, words: list[str]) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        # a long word is searched wherever it is
        parts = [self.vocabulary.paths([w if len(w) <= LONG else "" for w in words[at : at + LEARNT]]) for at in range(0, len(words), LEARNT)]
        self.paths = Paths.joined([self.paths, *parts])
        long = [self.known[w] for w in words if len(w) > LONG]
        self.paths.holds[long] = self.paths.counts_hold[long] = _NONE
        self.first = np.concatenate([[0], np.cumsum(self.paths.lengths)])

    def counts(self, texts: list[str | None]) -> list[int]:
        """Pieces of each text."""
        if not self.vocabulary.splits or self.vocabulary.bonus:
            return [self.vocabulary.search(self.normal(t))[0] for t in texts]
        words = [_WORD.findall(self.normal(t)) for t in texts]
        every = [w for own in words for w in own]
        new = set(every) - self.known.keys()
        if len(self.known) + len(new) > self.remembered:
            self._forget()
            new = set(every)
        self._learn(list(new))
        first = np.cumsum([0, *map(len, words)])
        ids = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        own = self.paths.of(ids)
        count = np.concatenate([[0], np.cumsum(own.pieces)])
        totals = count[first[1:]] - count[first[:-1]]
        text = np.repeat(np.arange(len(words)), np.diff(first))
        for t in np.unique(text[np.flatnonzero(self._doubtful(own, own.counts_hold, first))]).tolist():
            totals[t] = self._walk(words[t], ids[first[t] : first[t + 1]])
        return totals.tolist()

    def _doubtful(self, own: Paths, holds: np.ndarray, first: np.ndarray, score: float = 0.0) -> np.ndarray:
        """Which words' paths may not hold, if texts begin at first with score: 1 by rounding, 2 by REBASE, after which
        nothing is known of the words behind."""
        text = np.repeat(first[:-1], np.diff(first))
        before, count = np.cumsum(own.sums) - own.sums, np.cumsum(own.pieces) - own.pieces
        # the sum without rounding, and far more than rounding and other choices within it can have added for every piece
        size = (np.abs(score + before - before[text]) + own.reach) * (1 + (count - count[text]) * 2.0**-18)
        rounding = np.spacing((size + 1e-30).astype(np.float32)).astype(np.float64)
        by_rounding = (holds == _NONE) | (rounding >= holds) & (rounding > self.vocabulary.grain)
        return np.where(size >= -float(REBASE), 2, by_rounding)

    def _walk(self, words: list[str], ids: np.ndarray) -> int:
        """Pieces of a text, with its doubtful words searched from the very score."""
        score, total, at = np.float32(0), 0, 0
        while at < len(words):
            own = ids[at : at + WINDOW]
            paths = self.paths.of(own)
            doubtful = self._doubtful(paths, paths.holds, np.array([0, len(own)]), float(score))
            scores = self.paths.scores[np.arange(paths.lengths.sum()) + np.repeat(self.first[own] - (np.cumsum(paths.lengths) - paths.lengths), paths.lengths)]
            ends = np.cumsum(paths.lengths)
            done = 0
            for k in [*np.flatnonzero(doubtful).tolist(), len(own)]:
                if k > done:
                    score = np.add.accumulate(np.concatenate([[score], scores[ends[done] - paths.lengths[done] : ends[k - 1]]]), dtype=np.float32)[-1]
                    total += int(paths.pieces[done:k].sum())
                if k < len(own):
                    more, score = self.vocabulary.search(words[at + k], score)
                    total += more
                done = k + 1
                if k < len(own) and doubtful[k] == 2:
                    break
            at += min(done, len(own))
        return total


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, unigram_tokens) for each row of docs (doc_id, text, anything else): the pieces of the whole text's
    segmentation of highest score, as the tokenizer's library counts them of the file (see as_unigram).

    A null or empty text has 0. A null doc_id is carried, repeated rows repeat in the result. A character outside the
    vocabulary counts its bytes, or one for a run of them where the vocabulary has no bytes. vocabulary is read on
    the driver."""
    with open(vocabulary, "rb") as f:
        proto = as_unigram(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(proto)  # a vocabulary file, of a size that no corpus changes

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for a, b in ts.chunks(batch.column(1), CHUNK_BYTES):
            counts = counter.counts(batch.column(1).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64())], ["doc_id", "unigram_tokens"])

    return scan(texts(docs), run, "doc_id long, unigram_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, by a unigram model of the public file's byte-pair pieces."""
    return token_counts(table(spark, sf_dir, "documents"))
