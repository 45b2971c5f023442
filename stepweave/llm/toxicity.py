"""Toxicity by weak supervision.

1. Lexicons are mined from a bounded sample of labelled documents: tokens and token beginnings that toxic documents have
   far more often than others (a likelihood ratio test), beside a seed list of insults.
2. Voters look at every document: the seed lexicon, patterns around it, disguised spellings, repeated hits, and the
   mined lexicons by kind and fold. A document's vote is a bit pattern; patterns are counted over all documents.
3. A generative label model (two classes, a dependency tree between voters) is fitted to those counts by expectation
   maximisation: it estimates each voter's accuracy and which voters repeat one another, without labels.
4. A linear classifier is trained on the posterior labels of a bounded sample of documents and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import textscan as ts
from stepweave.llm.common import scan, smallest, table, texts, written

#: Bounds of the two fitting samples, in documents of different text; parameters of train. Features are mined from these.
MAX_LABELLED, MAX_TRAINING = 20_000, 20_000
#: Kinds of feature: the whole token, and token beginnings of so many bytes.
KINDS = (0, 4, 6, 8, 10)
FOLDS = 3
#: Least likelihood ratio statistic of a mined feature, and least share of toxic documents after weighting classes equally.
SIGNIFICANCE, PURITY = 30.0, 0.9
SEEDS = (
    "idiot moron loser scum trash clown stupid worthless pathetic disgusting imbecile dumbass bastard asshole bitch cretin jerk "
    "dummkopf idiotisch arschloch wichser schlampe abschaum trottel idiota imbécil estúpido estúpida cabrón gilipollas basura asqueroso "
    "imbécile connard connasse salope crétin ordure enfoiré débile"
).split()
_SEED = "(?:" + "|".join(SEEDS) + ")"
PATTERNS = (
    rf"\b(?:you|he|she|they|we|u)(?: are|'re| r| is)? (?:all |such |just |nothing but )?(?:a |an |the )?{_SEED}s?\b",
    rf"\b(?:du|ihr|sie|tu|vous|eres|es|sois)(?: bist| seid| sind| es| êtes| un| una| ein| eine)* {_SEED}s?\b",
    rf"\b(?:this|that|these|such|what|and) (?:a |an )?{_SEED}s?\b",
    r"\b(?:1d[i1]o[t7]|[i1]d[i1]0t|m0r[o0]n|mor0n|l0ser|los3r|st[u\*]p[i1\*]d|tr[a@4\*]sh|scvm|b[i1\*]tch|a[s\$\*]{2}hole|cl0wn)\b",
)
_BITS = 20


def _hashed(words: list[str]) -> np.ndarray:
    return np.unique(ts.hash_tokens([w.lower() for w in words]))


def document_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, kind index) of every token's features; a feature is a 64-bit hash, told apart by kind."""
    tokens = ts.tokens(pc.utf8_lower(column), ts.PUNCTUATION)
    docs, hashes, kinds = [], [], []
    doc = tokens.doc
    for k, n in enumerate(KINDS):
        h, at = tokens.prefixes(n) if n else (tokens.hash, slice(None))
        docs.append(doc[at])
        hashes.append(ts.mix(h + np.uint64(k)) if n else h)
        kinds.append(np.full(len(h), k, np.int8))
    return np.concatenate(docs), np.concatenate(hashes), np.concatenate(kinds)


class Lookup:
    """A sorted set of hashes behind a table of their top bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the set, and where in it."""
        some = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(self.hashes):
            return some[:0], some[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[some]
        return some[hit], at[hit]


def _unique_pairs(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(doc):
        return doc, feature
    by = np.lexsort((feature, doc))
    doc, feature = doc[by], feature[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


def feature_statistics(sample: DataFrame) -> DataFrame:
    """(feature, kind, toxic, all): over sample (text, weight of toxic), the documents that have a feature."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        weights, column = np.array(batch.column(1), np.float64), batch.column(0)
        for a, b in ts.chunks(column):
            doc, feature, kind = document_features(column.slice(a, b - a))
            doc, packed = _unique_pairs(doc, feature)
            by = np.argsort(packed, kind="stable")
            doc, packed = doc[by], packed[by]
            if not len(packed):
                continue
            at = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
            where = np.argsort(feature, kind="stable")
            kinds = kind[where[np.searchsorted(feature[where], packed[at])]]
            toxic = np.add.reduceat(weights[a:b][doc], at)
            yield pa.RecordBatch.from_arrays([pa.array(packed[at].view(np.int64)), pa.array(kinds.astype(np.int32)), pa.array(toxic), pa.array(np.diff(np.append(at, len(packed))))], ["feature", "kind", "toxic", "n"])

    seen = scan(sample.select("text", F.col("weight").cast("double")), run, "feature long, kind int, toxic double, n long")
    return seen.groupBy("feature", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def significant(statistics: DataFrame, toxic: float, total: float, purity: float) -> list[tuple[int, int]]:
    """(feature, kind) of the features that toxic documents have far more often. They come from a bounded sample."""
    p = min(max(toxic / max(total, 1.0), 1e-6), 1 - 1e-6)
    a, n = F.col("toxic"), F.col("n").cast("double")
    term = lambda x, q: F.when(x > 0, x * F.ln(x / (n * q))).otherwise(0.0)
    g = 2 * (term(a, F.lit(p)) + term(n - a, F.lit(1 - p)))
    pure = (a / toxic) / (a / toxic + (n - a) / max(total - toxic, 1.0))
    rows = statistics.select("feature", "kind", g.alias("g"), pure.alias("pure")).where((F.col("g") >= SIGNIFICANCE) & (F.col("pure") >= purity))
    return sorted((r[0], r[1]) for r in rows.collect())


@dataclass
class Voters:
    """What is looked for: seed hashes and mined features by voter."""

    seeds: np.ndarray
    mined: np.ndarray
    voter: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, mined: list[tuple[int, int]]) -> Voters:
        names = ["seed", "seed twice", *(f"pattern {i}" for i in range(len(PATTERNS)))]
        names += [f"mined {'token' if not n else f'beginning {n}'} {f}" for n in KINDS for f in range(FOLDS)] + ["mined thrice"]
        hashes = np.array([f for f, _ in mined], np.int64).view(np.uint64)
        by = np.argsort(hashes)
        fold = (hashes % np.uint64(FOLDS)).astype(np.int64)
        base = 2 + len(PATTERNS)
        return cls(_hashed(SEEDS), hashes[by], (base + np.array([k for _, k in mined], np.int64) * FOLDS + fold)[by], names)

    @cached_property
    def lookups(self) -> tuple[Lookup, Lookup]:
        return Lookup(self.seeds), Lookup(self.mined)

    def votes(self, column: pa.Array) -> np.ndarray:
        """The vote pattern of each document: bit i is set if voter i says toxic."""
        out = np.zeros(len(column), np.int64)
        doc, feature, kind = document_features(column)
        whole = kind == 0
        hit, _ = self.lookups[0].find(feature[whole])
        count = np.bincount(doc[whole][hit], minlength=len(column))
        out |= (count >= 1).astype(np.int64) | (count >= 2).astype(np.int64) << 1
        lower = pc.utf8_lower(column)
        matches = lambda texts, pattern: np.array(pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False), bool)
        # all patterns but the last hold a seed, if only as a part of a token
        seeded = np.flatnonzero(matches(lower, _SEED))
        for i, pattern in enumerate(PATTERNS):
            rows = np.arange(len(column)) if i == len(PATTERNS) - 1 else seeded
            if len(rows):
                out[rows[matches(lower.take(pa.array(rows)), pattern)]] |= 1 << (2 + i)
        hit, at = self.lookups[1].find(feature)
        np.bitwise_or.at(out, doc[hit], np.int64(1) << self.voter[at])
        d, _ = _unique_pairs(doc[hit], at)
        out |= (np.bincount(d, minlength=len(column)) >= 3).astype(np.int64) << (len(self.names) - 1)
        return out


class LabelModel:
    """Two hidden classes and voters whose dependencies, given the class, form a tree.

    Accuracies are the voters' rates of firing in either class; correlations are the tree's conditional tables, on the
    pairs of voters with most mutual information given the class. Fitted by expectation maximisation to counts of vote
    patterns; the class that fires less is the clean one."""

    def __init__(self, voters: int, rounds: int = 60, smoothing: float = 1.0):
        self.voters, self.rounds, self.smoothing = voters, rounds, smoothing
        self.prior = 0.1
        self.parent = np.full(voters, -1)
        #: rates[i, c, v]: how often voter i fires in class c when its parent votes v
        self.rates = np.zeros((voters, 2, 2))

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        if not len(patterns):
            self.rates[:] = 0.5
            return self
        bits = self._bits(patterns)
        posterior = np.clip(0.02 + 0.45 * bits.sum(1), 0, 0.98)
        for step in range(self.rounds):
            weight = np.stack([counts * (1 - posterior), counts * posterior])
            if step % 10 == 5:
                self.parent = self._tree(bits, weight)
            self.prior = float(np.clip(weight[1].sum() / max(counts.sum(), 1), 1e-4, 0.5))
            for i in range(self.voters):
                up = bits[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(bits), bool)
                for c in (0, 1):
                    for v in (0, 1):
                        w = weight[c] * (up == bool(v))
                        base = (weight[c] @ bits[:, i] + 0.01) / (weight[c].sum() + 1)
                        self.rates[i, c, v] = (w @ bits[:, i] + self.smoothing * base) / (w.sum() + self.smoothing)
            self.rates = np.clip(self.rates, 1e-6, 1 - 1e-6)
            new = self.posterior(patterns)
            if np.abs(new - posterior).max() < 1e-6 and step > 10:
                break
            posterior = new
        return self

    def _bits(self, patterns: np.ndarray) -> np.ndarray:
        return (patterns[:, None] >> np.arange(self.voters)) & 1 == 1

    def _tree(self, bits: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A spanning tree of most conditional mutual information, by parents."""
        info = np.zeros((self.voters, self.voters))
        total = weight.sum() + 1e-9
        for w in weight:
            mass, b = w.sum() + 1e-9, bits.astype(float)
            both, one = (b * w[:, None]).T @ b / mass, w @ b / mass
            for x in (0, 1):
                for y in (0, 1):
                    joint = both if x and y else one[:, None] - both if x else one[None, :] - both if y else 1 - one[:, None] - one[None, :] + both
                    px, py = (one if x else 1 - one)[:, None], (one if y else 1 - one)[None, :]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        info += mass / total * np.nan_to_num(np.where(joint > 1e-12, joint * np.log(joint / (px * py)), 0))
        parent, reached, best, via = np.full(self.voters, -1), np.zeros(self.voters, bool), np.full(self.voters, -1.0), np.full(self.voters, -1)
        for _ in range(self.voters):
            i = int(np.argmax(np.where(reached, -2, best)))
            reached[i], parent[i] = True, via[i]
            better = ~reached & (info[i] > best)
            best[better], via[better] = info[i][better], i
        return parent

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        bits = self._bits(patterns)
        score = np.full(len(bits), np.log(self.prior / (1 - self.prior)))
        for i in range(self.voters):
            up = (bits[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(bits), bool)).astype(int)
            p, q = self.rates[i, 1, up], self.rates[i, 0, up]
            score += np.where(bits[:, i], np.log(p / q), np.log((1 - p) / (1 - q)))
        return 1 / (1 + np.exp(-np.clip(score, -60, 60)))


@dataclass
class Classifier:
    """A linear classifier over the presence of features."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.features)

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of each document; 0 for a null or empty text."""
        doc, feature, _ = document_features(column)
        hit, at = self.lookup.find(feature)
        d, f = _unique_pairs(doc[hit], at)
        z = self.bias + np.bincount(d, self.weights[f], minlength=len(column))
        full = np.array(pc.fill_null(pc.binary_length(column), 0)) > 0
        return np.where(full, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)


def fit_linear(doc: np.ndarray, feature: np.ndarray, docs: int, features: int, target: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam over sparse rows (doc, feature)."""
    w, bias = np.zeros(features), -2.0
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    weight = weight / max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        z = bias + np.bincount(doc, w[feature], minlength=docs)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target)
        grad = np.append(np.bincount(feature, error[doc], minlength=features) + l2 * w, error.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def _texts_of(docs: DataFrame, picked: DataFrame, *values: str) -> DataFrame:
    """(text, values) of the picked (doc_id, key, values), each once however many rows have it; picked is no larger than a
    sample's bound, so it is broadcast and no text but theirs is moved."""
    keyed = docs.withColumn("key", F.xxhash64("text"))
    rows = keyed.join(F.broadcast(picked), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.min("text").alias("text"), *(F.max(v).alias(v) for v in values))
    return written(rows.select("text", *values))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_training: int = MAX_TRAINING) -> tuple[Classifier, LabelModel, Voters]:
    """The classifier for docs (doc_id, text), with labels (doc_id, toxic) of some of them.

    Lexicons are mined from at most max_labelled labelled documents and the linear model is fitted to at most max_training
    documents, both chosen by a hash of doc_id and text; votes are taken and counted over all documents."""
    spark = docs.sparkSession
    docs = texts(docs).where("text is not null")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("weight")).where("doc_id is not null and weight is not null")
    known = written(known.groupBy("doc_id").agg(F.max("weight").alias("weight")))
    of_labels = F.broadcast(smallest(known, max_labelled, "doc_id", "weight"))
    pairs = smallest(written(docs.select("doc_id", F.xxhash64("text").alias("key")).join(of_labels, "doc_id")), max_labelled, "doc_id", "key", "weight")
    sample = _texts_of(docs, pairs, "weight")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    mined = significant(feature_statistics(sample), toxic, total, PURITY) if toxic and total > toxic else []
    voters = Voters.of(mined)
    shared = spark.sparkContext.broadcast(voters)

    def vote(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in ts.chunks(batch.column(2)):
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(shared.value.votes(batch.column(2).slice(a, b - a)))], ["doc_id", "key", "pattern"])

    votes = written(scan(docs.select("doc_id", F.xxhash64("text").alias("key"), "text"), vote, "doc_id long, key long, pattern long"))
    # at most 2 ** voters rows, however many documents
    rows = votes.groupBy("pattern").count().collect()
    patterns, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
    model = LabelModel(len(voters.names)).fit(patterns, counts)
    posterior = dict(zip(patterns.tolist(), model.posterior(patterns).tolist()))
    votes = votes.where("doc_id is not null")
    silent, loud = float(counts[patterns == 0].sum()), float(counts[patterns != 0].sum())
    halves = []
    for half, size in ((votes.where("pattern <> 0"), loud), (votes.where("pattern = 0"), silent)):
        share = max(size / max(min(size, max_training / 2), 1), 1e-9)
        halves.append(smallest(half, max_training // 2, "doc_id", "key", "pattern").withColumn("importance", F.lit(share)))
    training = _texts_of(docs, halves[0].unionAll(halves[1]), "pattern", "importance")
    soft = spark.createDataFrame([(int(p), float(q)) for p, q in posterior.items()], "pattern long, weight double")
    labelled = training.join(F.broadcast(soft), "pattern")  # at most 2 ** voters rows
    total, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    more = significant(feature_statistics(labelled), toxic, total, PURITY) if toxic and total > toxic else []
    features = np.unique(np.concatenate([voters.seeds, voters.mined, np.array([f for f, _ in more], np.int64).view(np.uint64)]))

    def present(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        look, column = Lookup(features), batch.column(0)
        for a, b in ts.chunks(column):
            doc, feature, _ = document_features(column.slice(a, b - a))
            hit, at = look.find(feature)
            d, f = _unique_pairs(doc[hit], at)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(b - a + 1)).astype(np.int32)), pa.array(f.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["f", "weight", "importance"])

    # at most max_training rows, each with the few features that it has
    rows = scan(labelled.select("text", "weight", "importance"), present, "f array<int>, weight double, importance double").collect()
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    feature = np.concatenate([np.array(r[0], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    weights, bias = fit_linear(doc.astype(np.int64), feature, len(rows), len(features), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Classifier(features, weights, bias), model, voters


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score, toxic) for each row of docs; a null or empty text scores 0."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in ts.chunks(batch.column(1)):
            column = batch.column(1).slice(a, b - a)
            scores = shared.value.scores(column)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores), pa.array(scores >= 0.5)], ["doc_id", "score", "toxic"])

    return scan(texts(docs), run, "doc_id long, score double, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, toxic) for each row of docs (doc_id, text, anything else), by a classifier trained on docs and
    labels (doc_id, toxic).

    Null and empty texts score 0. Labels without doc_id or toxic are left out, of several of one document the
    largest counts; without labels the seeds and patterns vote alone. Rows with a null doc_id are scored. Repeated rows
    repeat in the result."""
    return score(docs, train(docs, labels)[0])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text doesn't score as toxic; the decision goes by the row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels)[0])
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(at)
        for a, b in ts.chunks(column):
            yield batch.slice(a, b - a).filter(pa.array(shared.value.scores(column.slice(a, b - a)) < 0.5))

    plain = docs.withColumn("text", F.col("text").cast("string"))
    return scan(plain, run, plain.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
