"""A quality classifier by positive-unlabelled learning.

Trusted documents are the positives; the corpus is unlabelled, a mixture of good and bad in an unknown share. Statistics of
every text are taken once and written; their means and deviations, and the class prior, are those of all documents. The
prior is estimated from all documents' scores by a first classifier, and a linear model over the statistics minimises the
non-negative unbiased risk pi R+(p) + max(0, R-(u) - pi R-(p)): the part of the unlabelled text that must be positive
is taken out of its negative risk, and where that turns negative by overfitting, its gradient is reversed. Only the steps of
that descent are taken on bounded samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import textscan as ts
from stepweave.llm.common import scan, smallest, table, texts, written

#: Bounds of the samples of the descent, in documents of different text; parameters of train.
MAX_POSITIVE, MAX_UNLABELLED = 20_000, 20_000
#: Scores are counted in so many bins of equal width.
BINS = 4096
FEATURES = (
    "log_tokens token_bytes upper digits letters space ascii_punctuation symbols exclaims non_ascii distinct_tokens top_token "
    "repeated_pairs adjacent_repeats symbol_tokens long_tokens log_lines line_tokens distinct_lines sentence_marks"
).split()

_UPPER, _DIGIT, _LETTER = (np.array([f(chr(b)) if b < 128 else False for b in range(256)]) for f in (str.isupper, str.isdigit, str.isalpha))
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#$%&*@^~|<>{}[]\\=+_/"])
_MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:?!"])


def _line_tokens(column: pa.Array) -> ts.Tokens:
    newline = np.zeros(256, bool)
    newline[[10, 13]] = True
    return ts.tokens(column, newline)


def _distinct(doc: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each document has, and how often its most frequent one occurs."""
    if not len(hashes):
        return np.zeros(docs), np.zeros(docs)
    by = np.lexsort((hashes, doc))
    d, h = doc[by], hashes[by]
    at = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
    run = np.diff(np.append(at, len(h)))
    top = np.zeros(docs)
    np.maximum.at(top, d[at], run)
    return np.bincount(d[at], minlength=docs).astype(float), top


def text_statistics(column: pa.Array) -> np.ndarray:
    """FEATURES of each document; all 0 for a null or empty text."""
    raw, off = ts.text_buffers(column)
    docs, size = len(column), np.maximum(np.diff(off), 1).astype(float)
    count = lambda mask: ts.groups_sum(mask.astype(np.uint8), off) / size
    tokens, lines = ts.tokens(column), _line_tokens(column)
    n, n_lines = np.diff(tokens.first).astype(float), np.diff(lines.first).astype(float)
    some, some_lines, doc = np.maximum(n, 1), np.maximum(n_lines, 1), tokens.doc
    distinct, top = _distinct(doc, tokens.hash, docs)
    pairs, at = tokens.windows(2)
    distinct_pairs, _ = _distinct(doc[at], pairs, docs)
    again = np.bincount(doc[at], tokens.hash[at] == tokens.hash[at + 1], minlength=docs) if len(at) else np.zeros(docs)
    distinct_lines, _ = _distinct(lines.doc, lines.hash, docs)
    per = lambda mask: np.bincount(doc, mask, minlength=docs) / some if len(doc) else np.zeros(docs)
    last = raw[tokens.at + (tokens.end - tokens.start) - 1] if len(doc) else raw[:0]
    return np.stack(
        [
            np.log1p(n), ts.groups_sum((tokens.end - tokens.start), tokens.first) / some, count(_UPPER[raw]), count(_DIGIT[raw]), count(_LETTER[raw]), count(ts.SPACE[raw]),
            count(_MARK[raw]), count(_SYMBOL[raw]), count(raw == ord("!")), count(raw >= 128), distinct / some, top / some,
            1 - distinct_pairs / np.maximum(n - 1, 1) * (n > 1) - (n <= 1), again / some, per(_SYMBOL[last] | (last == ord("!"))), per(tokens.end - tokens.start > 25), np.log1p(n_lines), n / some_lines,
            distinct_lines / some_lines, per(_MARK[last]),
        ],
        axis=1,
    ) * (n > 0)[:, None]


@dataclass
class Model:
    """A linear model over standardised statistics, their squares and their logarithms."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def inputs(self, statistics: np.ndarray) -> np.ndarray:
        return _standard(_expand(statistics), self.mean, self.scale)

    def margins(self, statistics: np.ndarray) -> np.ndarray:
        return self.inputs(statistics) @ self.weights + self.bias


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x * x, np.log(np.abs(x) + 1e-3)], axis=1)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def estimate_prior(positive: np.ndarray, counts: np.ndarray) -> float:
    """The largest share of positives that the unlabelled scores allow: the least ratio, over thresholds that keep enough
    of the positives, of what passes of the unlabelled and of the positives. A prior too large does more harm than one
    too small, so no allowance is made for the least of several ratios being a low one. positive are the bins of
    scores, counts those of all unlabelled by bin."""
    best, every = 1.0, max(counts.sum(), 1)
    passing = np.append(np.cumsum(counts[::-1])[::-1], 0)
    for q in np.linspace(0.05, 0.8, 31):
        t = int(np.quantile(positive, q, method="nearest"))
        # above the threshold: u = prior p + (1 - prior) n, n >= 0
        p, u = float((positive >= t).mean()), float(passing[t] / every)
        best = min(best, u / max(p, 1e-9))
    return float(np.clip(best, 0.05, 0.99))


def score_bins(margins: np.ndarray) -> np.ndarray:
    return np.clip((1 / (1 + np.exp(-np.clip(margins, -40, 40))) * BINS).astype(np.int64), 0, BINS - 1)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 2000, batch: int = 512, rate: float = 0.01, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative unbiased risk with the sigmoid loss, by Adam over random batches."""
    rng = np.random.default_rng(7)
    k = positive.shape[1]
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    ones = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1)
    positive, unlabelled = ones(positive), ones(unlabelled)
    for t in range(1, steps + 1):
        p, u = positive[rng.integers(0, len(positive), batch)], unlabelled[rng.integers(0, len(unlabelled), batch)]
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -40, 40))), 1 / (1 + np.exp(-np.clip(u @ w, -40, 40)))
        slope = lambda s, x: (s * (1 - s)) @ x / len(x)
        # losses: 1 - sigmoid(z) for the positive class, sigmoid(z) for the negative
        negative = su.mean() - prior * sp.mean()
        grad_negative = slope(su, u) - prior * slope(sp, p)
        grad = -prior * slope(sp, p) + grad_negative if negative >= 0 else -grad_negative
        grad = grad + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def statistics_of(docs: DataFrame) -> DataFrame:
    """(doc_id, x): FEATURES of each row of docs."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in ts.chunks(batch.column(1)):
            x = text_statistics(batch.column(1).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(x)], ["doc_id", "x"])

    return scan(texts(docs), run, "doc_id long, x array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the inputs of all rows (x): each task sums its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0.0, np.zeros(3 * len(FEATURES)), np.zeros(3 * len(FEATURES))
        for batch in batches:
            if len(batch):
                x = _expand(_matrix(batch.column(0)))
                n, total, squares = n + len(x), total + x.sum(0), squares + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([_lists(np.concatenate([[n], total, squares])[None])], ["sums"])

    each = rows.select("x").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "s"))
    sums = np.array([r[0] for r in each.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").select("s").collect()])
    n, k = max(sums[0], 1.0), 3 * len(FEATURES)
    mean = sums[1 : k + 1] / n
    return mean, np.sqrt(np.maximum(sums[k + 1 :] / n - mean * mean, 0)) + 1e-6


def _score_counts(rows: DataFrame, model: Model) -> np.ndarray:
    """How many rows (x) have a score in each bin."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            if len(batch):
                counts += np.bincount(score_bins(shared.value.margins(_matrix(batch.column(0)))), minlength=BINS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bin", "n"])

    out = np.zeros(BINS)
    for r in rows.select("x").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most n of the different x of rows, in an order that depends on these alone."""
    found = [r[0] for r in smallest(rows, n, "x").collect()]
    x = np.array(found, np.float64).reshape(-1, len(FEATURES))
    x = x[np.lexsort(x.T)] if len(x) else x
    return x[np.random.default_rng(3).permutation(len(x))]


def train(rows: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """A model of the statistics (doc_id, x) of the corpus, with labels (doc_id, quality) of some of it: quality 1 is trusted.
    None without trusted documents."""
    rows = rows.where("x[0] > 0")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null")
    trusted = written(known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1"))
    p = _sample(written(rows.join(F.broadcast(smallest(trusted, max_positive, "doc_id")), "doc_id").select("x")), max_positive)
    u = _sample(rows, max_unlabelled)
    if not len(p):
        return None
    mean, scale = _moments(rows)
    inputs = lambda x: _standard(_expand(x), mean, scale)
    prior, half = 0.5, len(p) // 2
    if half:
        # the prior from scores of positives that the first classifier wasn't fitted to, and of all documents
        weights, bias = fit_nnpu(inputs(p[:half]), inputs(u), prior)
        first = Model(mean, scale, weights, bias, prior)
        prior = estimate_prior(score_bins(first.margins(p[half:])), _score_counts(rows, first))
    weights, bias = fit_nnpu(inputs(p), inputs(u), prior)
    return Model(mean, scale, weights, bias, prior)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, keep) for each row of docs (doc_id, text, anything else): the probability-like score of the model and
    whether it is 0.5 or more.

    Texts without tokens (null, empty, blank) score 0 and aren't kept. If there is nothing to learn from, all
    others score 1. A null doc_id is scored; repeated rows repeat in the result. Of several labels of a document
    the lowest counts."""
    rows = written(statistics_of(docs))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(batch):
            x = _matrix(batch.column(1))
            z = np.ones(len(x)) if shared.value is None else 1 / (1 + np.exp(-np.clip(shared.value.margins(x), -40, 40)))
            z = np.where(x[:, 0] > 0, z, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z), pa.array(z >= 0.5)], ["doc_id", "score", "keep"])

    return scan(rows, run, "doc_id long, score double, keep boolean")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the labels of good ones."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
