"""Operator 10: quality by ordinal cumulative-link regression.

Ratings are ordered grades.  One shared weight vector over hashed text
features gives a text's latent quality; ordered thresholds cut it into grades:
P(grade <= k) = sigmoid(threshold_k - w.x).  From these come the expected grade
and the tail probability P(grade >= k) that decides the selection.

Features are hashed words and word shapes (case, digits, punctuation), shares
of repeated and distinct words among them.  Training uses a bounded sample, the
first MAX_RATED rated texts by hash of the id; every whole text is scored.

Defined results: null and empty texts have the features of no words; repeated
rows score alike; null ratings and ratings of unknown documents are left out,
of several ratings of one id the highest counts; with fewer than two grades
every tail probability is 1; an empty table gives no rows; input columns named
like outputs are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from proofsheet.llm.text import slices

MAX_RATED = 12_000
DIMENSIONS = 1 << 16
STEPS, RATE, DECAY, BATCH = 400, 0.05, 1e-3, 1024
#: Distinct words a task remembers.
CACHE_WORDS = 300_000

#: Letters and digits by kind, other bytes as they are.
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+")


def _hash(feature: bytes) -> int:
    return zlib.crc32(feature) % DIMENSIONS


class Features:
    """Hashed features of a text: sorted indices and their values."""

    def __init__(self):
        self.seen: dict[bytes, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        counts, seen = Counter(words), self.seen
        shapes: Counter[int] = Counter()
        index, value = [], []
        for word, n in counts.items():
            got = seen.get(word)
            if got is None:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                got = seen[word] = (_hash(b"w" + word.lower()), _hash(b"s" + _RUN.sub(rb"\1", word.translate(_SHAPE))))
            index.append(got[0])
            value.append(n)
            shapes[got[1]] += n
        total = max(1, len(words))
        value_ = np.log1p(np.array(value, dtype=np.float64))
        value_ /= max(np.sqrt((value_ ** 2).sum()), 1e-9)
        again = sum(a == b for a, b in zip(words, words[1:])) / total
        style = {b"distinct%d" % int(10 * len(counts) / total): 1.0, b"again%d" % int(10 * again): 1.0,
                 b"length%d" % min(12, len(words).bit_length()): 0.5}
        return (np.array([*index, *shapes, *map(_hash, style)], dtype=np.int32),
                np.concatenate([value_, 3.0 * np.array(list(shapes.values()), dtype=np.float64) / total, list(style.values())]))


@dataclass
class OrdinalModel:
    grades: list[float]
    weights: np.ndarray = field(repr=False)
    thresholds: np.ndarray = field(repr=False)

    def below(self, z: np.ndarray) -> np.ndarray:
        """P(grade <= grades[k]) for all but the last grade; one row per text."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_grades: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the cumulative-link likelihood.
    Thresholds are a first one and positive steps, so that they stay ordered."""
    rnd = np.random.default_rng(seed)
    w = np.zeros(DIMENSIONS)
    share = np.cumsum(np.bincount(y, minlength=n_grades) + 1.0)[:-1] / (len(y) + n_grades)
    cut = np.log(share / (1 - share))
    t0 = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    params = np.concatenate([w, t0])
    m, v = np.zeros_like(params), np.zeros_like(params)
    thresholds = lambda t: np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
    for t in range(1, STEPS + 1):
        which = rnd.choice(len(rows), size=min(BATCH, len(rows)), replace=False)
        index = np.concatenate([rows[i][0] for i in which])
        value = np.concatenate([rows[i][1] for i in which])
        owner = np.repeat(np.arange(len(which)), [len(rows[i][0]) for i in which])
        z = np.bincount(owner, params[index] * value, minlength=len(which))
        th = thresholds(params[DIMENSIONS:])
        cdf = np.concatenate([np.zeros((len(z), 1)), 1 / (1 + np.exp(-np.clip(th[None, :] - z[:, None], -30, 30))), np.ones((len(z), 1))], axis=1)
        k, at = y[which], np.arange(len(which))
        p = np.maximum(cdf[at, k + 1] - cdf[at, k], 1e-9)
        slope = cdf * (1 - cdf)
        g_z = (slope[at, k + 1] - slope[at, k]) / p / len(which)  # d(-log p)/dz
        g_th = np.zeros(n_grades + 1)
        np.add.at(g_th, k + 1, -slope[at, k + 1] / p / len(which))
        np.add.at(g_th, k, slope[at, k] / p / len(which))
        g_th = g_th[1:-1]
        tail = np.cumsum(g_th[::-1])[::-1]
        g = np.concatenate([np.bincount(index, g_z[owner] * value, minlength=DIMENSIONS) + DECAY * params[:DIMENSIONS] / 100,
                            tail * np.concatenate([[1.0], np.exp(params[DIMENSIONS + 1:])])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return params[:DIMENSIONS], thresholds(params[DIMENSIONS:])


def train(docs: DataFrame, ratings: DataFrame, grade: Column, in_training: Column | None = None,
          doc_id: str = "doc_id", text: str = "text") -> OrdinalModel:
    """``grade`` is an expression over ``ratings``; ``in_training`` a condition over the id."""
    known = ratings.withColumn("__grade", grade.cast("double")).where(F.col("__grade").isNotNull() & F.col(doc_id).isNotNull())
    known = known.where(in_training) if in_training is not None else known
    known = known.groupBy(doc_id).agg(F.max("__grade").alias("__grade"))
    chosen = known.orderBy(F.xxhash64(F.col(doc_id).cast("string")), doc_id).limit(MAX_RATED)  # bounded by the parameter

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                                              pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["grade", "i", "x"])

    sample = (docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(chosen), doc_id).select(F.col("__grade").alias("grade"), "text")
              .mapInArrow(encode, "grade double, i array<int>, x array<float>").toArrow())
    y = sample.column("grade").to_numpy()
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return OrdinalModel(grades or [0.0], np.zeros(DIMENSIONS), np.empty(0))
    rows = [(i.values.to_numpy(), x.values.to_numpy().astype(np.float64)) for i, x in
            zip(sample.column("i").combine_chunks(), sample.column("x").combine_chunks())]
    order = sorted(range(len(rows)), key=lambda r: (y[r], rows[r][0].tobytes(), rows[r][1].tobytes()))  # the same order each time
    w, th = fit_ordinal([rows[r] for r in order], np.searchsorted(grades, y[order]), len(grades))
    return OrdinalModel(grades, w, th)


def grade(docs: DataFrame, model: OrdinalModel, at_least: float, text: str = "text",
          names: tuple[str, str, str] = ("latent", "expected_grade", "tail")) -> DataFrame:
    """``docs`` with the latent quality, the expected grade, and the probability
    of a grade of ``at_least`` or more, under ``names``."""
    new = list(names)
    rest = docs.drop(*new)
    fields = [f for f in rest.schema.fields]
    at = rest.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model.grades, model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, weights, thresholds = shared.value
        own, features = OrdinalModel(grades, weights, thresholds), Features()
        first = int(np.searchsorted(grades, at_least))
        for batch in slices(batches, fields[at].name):
            z = np.array([float(weights[i] @ x) for i, x in map(features, batch.column(at).to_pylist())])
            below = own.below(z)
            upto = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1)
            expected = np.diff(upto, axis=1) @ np.array(grades)
            tail = 1.0 - upto[:, min(first, len(grades) - 1)] if len(grades) > 1 else np.ones(len(z))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z), pa.array(expected), pa.array(tail)], [*batch.schema.names, *new])

    return rest.mapInArrow(run, StructType([*fields, *[StructField(n, DoubleType()) for n in new]]))
