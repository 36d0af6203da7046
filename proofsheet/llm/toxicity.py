"""Operator 4: toxicity by non-negative positive-unlabelled learning.

A numpy logistic model over the presence of words and word beginnings learns
from confirmed toxic texts and from unlabelled text.  The unlabelled risk, corrected for the share of
toxic texts in it (the class prior), estimates the risk on clean text; where
that estimate turns negative the model has begun to overfit, and the step goes
the other way (the non-negative estimator).

Training uses a bounded sample: at most MAX_POSITIVE confirmed toxic texts and
MAX_UNLABELLED others (first by hash of the id).  Features are those of at least
MIN_DOCS confirmed texts whose share of documents differs by MIN_Z standard
errors between the two sets, at most MAX_FEATURES.  The prior counts all labels
of the training folds.  Every whole text is scored.

Defined results: null and empty texts get the score of no words; repeated rows
are scored alike; without toxic labels all scores are 0; an empty table gives
no rows; labels that are null, of unknown documents or repeated are left out
or counted once; input columns named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from proofsheet.llm.text import slices, word_bytes
from proofsheet.session import saved

MAX_POSITIVE, MAX_UNLABELLED, MIN_DOCS, MIN_Z, MAX_FEATURES = 4_000, 10_000, 5, 4.5, 20_000
#: Bytes of a word's beginning that are features when the word goes on.
STEMS = range(4, 10)
STEPS, RATE, DECAY, BATCH = 500, 0.05, 1e-4, 2048
#: Distinct words a task remembers.
CACHE_WORDS = 300_000


def word_features(word: bytes) -> list[bytes]:
    return [word, *[b"^" + word[:n] for n in STEMS if len(word) > n]]


class Lookup:
    """Feature numbers of a text's words, remembered by word."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids, self.seen = ids, {}

    def __call__(self, text: str | None) -> set[int]:
        out, seen = set(), self.seen
        for word in set(word_bytes(text)):
            got = seen.get(word)
            if got is None:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                got = seen[word] = tuple(self.ids[f] for f in word_features(word) if f in self.ids)
            if got:
                out.update(got)
        return out


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents of each set) summed within the task, handed on in parts."""
    counts: dict[bytes, list[int]] = {}

    def part():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([c[1] for c in counts.values()], pa.int64()),
                                           pa.array([c[0] for c in counts.values()], pa.int64())], ["feature", "p", "u"])

    for batch in slices(batches):
        for flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for f in {f for w in set(word_bytes(text)) for f in word_features(w)}:
                counts.setdefault(f, [0, 0])[flag] += 1
            if len(counts) > 400_000:
                yield part()
                counts.clear()
    if counts:
        yield part()


class Rows:
    """Sparse presence rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self.index = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)

    def __len__(self):
        return len(self.start) - 1

    def take(self, which: np.ndarray):
        at = np.concatenate([np.arange(self.start[i], self.start[i + 1]) for i in which] + [np.empty(0, int)]).astype(np.int64)
        return self.index[at], np.repeat(np.arange(len(which)), self.start[which + 1] - self.start[which])


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: Rows, unlabelled: Rows, n_words: int, prior: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk
    prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]), logistic l, by Adam."""
    rnd = np.random.default_rng(seed)
    w = np.zeros(n_words + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        grads = []
        for rows in (positive, unlabelled):
            which = rnd.choice(len(rows), size=min(BATCH, len(rows)), replace=False)
            index, owner = rows.take(which)
            z = w[-1] + np.bincount(owner, w[index], minlength=len(which))
            grads.append((index, owner, z, len(which)))

        def grad(part, coefficient):
            index, owner, _, n = part
            g = np.bincount(index, coefficient[owner], minlength=n_words + 1) / n
            g[-1] = coefficient.mean()
            return g

        p, u = grads
        sp, su = sigmoid(p[2]), sigmoid(u[2])
        clean_risk = np.logaddexp(0, u[2]).mean() - prior * np.logaddexp(0, p[2]).mean()
        clean_grad = grad(u, su) - prior * grad(p, sp)
        g = prior * grad(p, sp - 1) + clean_grad if clean_risk >= 0 else -clean_grad
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, in_training: Column, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> tuple[dict[bytes, float], float]:
    """Word weights and bias.  ``in_training`` is a condition over ``doc_id`` of either table."""
    order = F.xxhash64(F.col(doc_id).cast("string"))
    known = (labels.where(in_training & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
             .groupBy(doc_id).agg(F.max(label).alias("__label")))
    n, toxic = known.agg(F.count("*"), F.count_if(F.col("__label") == 1)).first()
    if not toxic:
        return {}, -30.0
    prior = min(max(toxic / n, 1e-3), 0.9)
    yes = known.where("__label = 1").orderBy(order, doc_id).limit(MAX_POSITIVE).select(doc_id, F.lit(1).alias("positive"))
    some = docs.where(in_training & F.col(doc_id).isNotNull()).select(doc_id).distinct().orderBy(order, doc_id).limit(MAX_UNLABELLED)
    chosen = yes.unionByName(some.select(doc_id, F.lit(0).alias("positive")))  # at most MAX_POSITIVE + MAX_UNLABELLED ids
    sample = saved(docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(chosen), doc_id).select("positive", "text"))
    size = {r[0]: r[1] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    if not n_p or not n_u:
        return {}, float(np.log(prior / (1 - prior)))
    pooled = (F.col("p") + F.col("u")) / F.lit(float(n_p + n_u))
    z = (F.col("p") / F.lit(float(n_p)) - F.col("u") / F.lit(float(n_u))) / F.sqrt(
        pooled * (1 - pooled) * F.lit(1.0 / n_p + 1.0 / n_u) + F.lit(1e-9))
    features = [r[0] for r in sample.mapInArrow(_count_features, "feature binary, p long, u long")
                .groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= MIN_DOCS)
                .select("feature", F.abs(z).alias("z")).where(F.col("z") >= MIN_Z)
                .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]
    ids = {bytes(f): i for i, f in enumerate(features)}
    if not ids:
        return {}, float(np.log(prior / (1 - prior)))
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def encode(batches):
        look = Lookup(shared.value)
        for batch in slices(batches):
            rows = [sorted(look(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["positive", "words"])

    encoded = sample.mapInArrow(encode, "positive int, words array<int>").toArrow()
    flag = encoded.column("positive").to_numpy()
    rows = [np.asarray(x, dtype=np.int32) for x in encoded.column("words").to_pylist()]
    order_ = sorted(range(len(rows)), key=lambda i: (flag[i], rows[i].tobytes()))  # the same sample in the same order each time
    positive, unlabelled = (Rows([rows[i] for i in order_ if flag[i] == k]) for k in (1, 0))
    weights, bias = fit_nnpu(positive, unlabelled, len(ids), prior)
    return {f: float(weights[i]) for f, i in ids.items()}, bias


def score(docs: DataFrame, weights: dict[bytes, float], bias: float, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rest = docs.drop(name)
    fields, at = rest.schema.fields, rest.columns.index(text)

    def run(batches):
        look, w = Lookup({f: i for i, f in enumerate(shared.value)}), list(shared.value.values())
        for batch in slices(batches, fields[at].name):
            z = np.array([bias + sum(w[i] for i in sorted(look(t))) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(z))], [*batch.schema.names, name])

    return rest.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))
