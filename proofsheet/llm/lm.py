"""Operator 1: language-model scores from a log-bilinear model trained with
noise-contrastive estimation.

Counts: one pass sums every training token; the table of counts grows with the
corpus and stays distributed.  A head of its frequent tokens is broadcast;
texts' other tokens meet their counts by a join.

Model: the feature vectors of the CONTEXT tokens before, each weighted by its
position's vector, add up to a predicted vector r.  Words have output vectors
of their own; they are dealt into classes of like endings, and
P(word | context) = P(class | context) * P(word | class, context), both a
softmax of products with r plus biases.  Classes and the words of a class grow
with the cube root of the number V of distinct tokens, so that the words with
own vectors grow with V^(2/3) and the cost of a token with V^(1/3).  Tokens
beyond them fall into rare classes by their last bytes; a rare class is an
output like the others and hands its mass to its tokens by their discounted
counts, and what the discount frees to the one unseen token.  So the
probabilities after each context add up to one over the V known tokens and an
unseen one of each rare class.

Training: every partition of the training texts runs noise-contrastive
estimation in numpy over all its tokens, for the classes with noise from the
class frequencies and inside each class with noise from its words; parameters
are averaged by tokens, in a tree on the executors.  Scoring normalises with
matrix products, for the words one product a class over the block's tokens of it.

Defined results: null and empty texts are the end token alone; repeated rows
are counted and scored one by one; without training texts N is 0 and every
token, the end too, unseen; an empty table gives no rows; outputs replace input
columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm.text import slices
from proofsheet.session import saved

#: Tokens whose counts are broadcast, at least; classes of rare tokens on the context side.
HEAD_WORDS, CONTEXT_CLASSES = 1 << 17, 512
DIM, CONTEXT, NOISE, WORD_NOISE, BATCH, RATE = 16, 3, 32, 16, 1 << 14, 0.15
#: Discount of a rare class's token counts.
DISCOUNT = 0.5
END = b""
#: Tokens scored together, and tokens of one class product.
CHUNK, BLOCK = 1 << 17, 1 << 12
#: Bias of the places of a class that no word has.
NO_WORD = -1e30


# ---------------------------------------------------------------- tokens
def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lowered white-space tokens of all texts in one array, their number in each text)."""
    spaced = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(spaced)
    n = np.diff(lists.offsets.to_numpy())
    flat, empty = lists.flatten(), pc.equal(pc.binary_length(spaced), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # such a text is split into one empty token
        flat, n = flat.filter(pc.greater(pc.binary_length(flat), 0)), np.where(empty, 0, n)
    return flat.cast(pa.binary()), n


def endings(tokens: pa.Array) -> np.ndarray:
    """A number of 16 bits from the last three bytes of each token."""
    _, offsets, data = tokens.buffers()
    if not len(tokens):
        return np.empty(0, np.int64)
    at = np.frombuffer(offsets, np.int32)[tokens.offset:tokens.offset + len(tokens) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    mark = np.zeros(len(tokens), np.int64)
    for k in (3, 2, 1):
        mark = mark << 8 | np.where(at[1:] - at[:-1] >= k, data[np.clip(at[1:] - k, 0, len(data) - 1)], 0)
    return (mark * 2654435761 & 0xFFFFFFFF) >> 16


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, mark, n) over all texts, the end of each included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in slices(batches):
            flat, _ = tokens_of(batch.column(0))
            counts = pc.value_counts(flat)
            token = counts.field("values")
            yield pa.RecordBatch.from_arrays([token, pa.array(endings(token), pa.int32()), counts.field("counts")], ["token", "mark", "n"])
            ends += batch.num_rows
        if ends:
            token = pa.array([END], pa.binary())
            yield pa.RecordBatch.from_arrays([token, pa.array(endings(token), pa.int32()), pa.array([ends], pa.int64())], ["token", "mark", "n"])

    return texts.mapInArrow(run, "token binary, mark int, n long").groupBy("token", "mark").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The head of the counts and what follows from it.  Plain data: ``shared`` is broadcast."""

    def __init__(self, counts: DataFrame):
        level = F.floor(F.log2(F.col("n")) * 8).cast("int")
        steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()  # a few hundred
        self.total, self.distinct = sum(r["n"] for r in steps), sum(r["v"] for r in steps)
        side = 1 << max(2, (self.distinct + 1).bit_length() // 3)  # words of a class, and classes
        self.side, self.rare = side, max(2, side // 2)
        most, lowest, size = max(HEAD_WORDS, side * side), 10 ** 6, 0
        for r in sorted(steps, key=lambda r: -r["level"]):
            size += r["v"]
            if size > most:
                break
            lowest = r["level"]
        self.tail = counts.where(level < lowest)
        head = [(bytes(t), m, n) for t, m, n in counts.where((level >= lowest) & (F.col("token") != F.lit(END))).select("token", "mark", "n").collect()]
        head.sort(key=lambda x: (-x[2], x[0]))
        ends = counts.where(F.col("token") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
        # the end token and the most frequent ones are words; words of like endings make a class
        words = sorted([(END, 0, ends), *head[:side * side - 1]], key=lambda x: x[0][::-1])
        others = head[side * side - 1:]
        self.classes = -(-len(words) // side)
        rest = {r["cls"]: [r["n"], r["v"]] for r in counts.groupBy((F.col("mark") % self.rare).alias("cls"))
                .agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
        for _, mark, n in words:
            if n:
                mark = int(endings(pa.array([END], pa.binary()))[0]) if not _ else mark
                rest[mark % self.rare][0] -= n
                rest[mark % self.rare][1] -= 1
        self.rare_n = np.array([rest.get(c, (0, 0))[0] for c in range(self.rare)], float)
        self.rare_v = np.array([rest.get(c, (0, 0))[1] for c in range(self.rare)], float)
        self.tokens = pa.array([t for t, _, _ in [*words, *others]], pa.binary())
        n = np.array([c for _, _, c in [*words, *others]], float)
        i, mark = np.arange(len(n)), np.array([m for _, m, _ in [*words, *others]], np.int64)
        self.words = len(words)
        own = i < self.words
        self.known = n > 0
        self.context = np.where(own, i, self.words + mark % CONTEXT_CLASSES).astype(np.int32)
        self.cls = np.where(own, i // side, self.classes + mark % self.rare).astype(np.int32)
        self.base = np.log10((n + 1) / (self.total + self.distinct + 1))
        inside = (n - DISCOUNT) / (self.rare_n[mark % self.rare] + 1)
        self.inside = np.where(own, 0.0, np.log10(np.maximum(inside, 1e-300)))
        self.end = next(k for k, w in enumerate(words) if w[0] == END)
        mass = np.zeros(self.classes * side)
        mass[:self.words] = n[:self.words] + 1e-3
        mass = mass.reshape(self.classes, side)
        self.class_noise = np.concatenate([mass.sum(axis=1), self.rare_n + 1])
        self.class_noise /= self.class_noise.sum()
        self.word_noise = mass / mass.sum(axis=1, keepdims=True)

    def shared(self) -> dict:
        return {k: getattr(self, k) for k in ("side", "rare", "classes", "words", "tokens", "known", "context", "cls", "base", "inside", "end", "class_noise", "word_noise")}


class Encoded:
    """A slice of texts as numbers: CONTEXT pads, a text's tokens, the end token, text after text."""

    def __init__(self, texts: pa.Array, v: dict):
        flat, n = tokens_of(texts)
        found = pc.index_in(flat, value_set=v["tokens"])
        lost = found.is_null().to_numpy(zero_copy_only=False)
        index = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(n + CONTEXT + 1)[:-1]]).astype(np.int64) if len(n) else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(n)), n)
        place = self.start[row] + CONTEXT + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ends = self.start + CONTEXT + n
        size = int((n + CONTEXT + 1).sum())
        #: number in the head, -1 for other tokens, -2 for pads
        self.number = np.full(size, -2, np.int64)
        self.number[place], self.number[ends] = index, v["end"]
        self.rare = flat.filter(pa.array(lost))
        self.rare_row, self.rare_mark = row[lost], endings(self.rare)
        known = np.maximum(self.number, 0)
        self.context = np.where(self.number == -2, v["words"] + CONTEXT_CLASSES, v["context"][known]).astype(np.int32)
        self.cls = np.where(self.number == -2, -1, v["cls"][known]).astype(np.int32)
        self.context[place[lost]] = v["words"] + self.rare_mark % CONTEXT_CLASSES
        self.cls[place[lost]] = v["classes"] + self.rare_mark % v["rare"]
        #: number of the word, -1 where the token has no vector of its own
        self.word = np.where((self.number >= 0) & (self.number < v["words"]), self.number, -1)
        self.at = np.flatnonzero(self.number != -2)
        self.n_tokens = n + 1


# ---------------------------------------------------------------- model
def start_parameters(v: dict) -> list[np.ndarray]:
    """Context vectors, position vectors, class and word outputs with biases: at the start the classes' and words' frequencies."""
    rnd = np.random.default_rng(11)
    shape = v["word_noise"].shape
    bias = np.where(v["word_noise"] > 0, np.log(np.maximum(v["word_noise"], 1e-300)), NO_WORD)
    return [rnd.normal(0, 0.1, (v["words"] + CONTEXT_CLASSES + 1, DIM)).astype(np.float32), np.full((CONTEXT, DIM), 1.0 / CONTEXT, np.float32),
            rnd.normal(0, 0.1, (len(v["class_noise"]), DIM)).astype(np.float32), np.log(v["class_noise"]).astype(np.float32),
            rnd.normal(0, 0.1, (shape[0] * shape[1], DIM)).astype(np.float32), bias.ravel().astype(np.float32)]


def predicted(x: Encoded, a: int, b: int, words: np.ndarray, position: np.ndarray):
    """The feature vectors from CONTEXT places before ``a`` to ``b``, and the predicted vectors at the places from ``a`` to ``b``."""
    features = words[x.context[a - CONTEXT:b]]
    return features, sum(features[before(i, b - a)] * position[i] for i in range(CONTEXT))


def before(i: int, n: int) -> slice:
    """Of such features, those of the i-th tokens before n places."""
    return slice(CONTEXT - 1 - i, CONTEXT - 1 - i + n)


def sorting(cells: np.ndarray) -> np.ndarray:
    """A stable order; small numbers sort much faster as 16 bits."""
    return np.argsort(cells.astype(np.uint16) if len(cells) and cells.max() < 1 << 16 else cells, kind="stable")


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def added(cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells that occur, rows of ``values`` added up for each of them)."""
    order = sorting(cells)
    cells = cells[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with noise shared within a batch, Adagrad steps on the rows that a batch touches."""

    def __init__(self, v: dict, seed: int):
        self.v, self.p = v, start_parameters(v)
        self.g2 = [np.full(x.shape, 1e-6, np.float32) for x in self.p]
        self.rnd = np.random.default_rng(seed)
        self.log_class = np.log(v["class_noise"] * NOISE).astype(np.float32)
        self.log_word = np.log(np.maximum(v["word_noise"] * WORD_NOISE, 1e-300)).astype(np.float32).ravel()
        until = np.cumsum(v["word_noise"], axis=1)
        # one ascending list: class c ends at c + 1
        self.until = (until / until[:, -1:] + np.arange(len(until))[:, None]).ravel()

    def learn(self, x: Encoded) -> None:
        """Stretches of BATCH places in random order."""
        starts = np.arange(CONTEXT, len(x.cls), BATCH)
        for a in self.rnd.permutation(starts).tolist():
            self.step(x, a, min(a + BATCH, len(x.cls)))

    def update(self, k: int, rows, g: np.ndarray) -> None:
        g2 = self.g2[k][rows] + g * g
        self.g2[k][rows] = g2
        self.p[k][rows] -= np.float32(RATE) * g / np.sqrt(g2)

    def step(self, x: Encoded, a: int, b: int) -> None:
        words, position, out, bias, word_out, word_bias = self.p
        side = self.v["side"]
        features, r_all = predicted(x, a, b, words, position)
        at = np.flatnonzero(x.cls[a:b] >= 0)
        at = at[sorting(x.word[a:b][at] + 1)]  # tokens without a vector first, then the words class by class
        r, target, word = r_all[at], x.cls[a:b][at], x.word[a:b][at]
        n = np.float32(max(len(at), 1))
        drawn = self.rnd.choice(len(out), size=NOISE, p=self.v["class_noise"])
        q_t, q_n = out[target], out[drawn]
        e_t = (sigmoid(np.einsum("ij,ij->i", r, q_t) + (bias - self.log_class)[target]) - 1) / n  # towards 1
        e_n = sigmoid(r @ q_n.T + (bias[drawn] - self.log_class[drawn])) / n  # towards 0
        g_r = e_t[:, None] * q_t + e_n @ q_n
        outs = added(np.concatenate([target, drawn]), np.concatenate([np.concatenate([e_t[:, None] * r, e_n.T @ r]),
                                                                      np.concatenate([e_t, e_n.sum(axis=0)])[:, None]], axis=1))
        # inside the classes of words
        skip = int(np.searchsorted(word, 0))
        word, r_own = word[skip:], r[skip:]
        cuts = np.searchsorted(word, np.arange(self.v["classes"] + 1) * side)
        used = np.flatnonzero(np.diff(cuts))
        spans = list(zip(used.tolist(), cuts[used].tolist(), cuts[used + 1].tolist()))
        picks = np.searchsorted(self.until, self.rnd.random((self.v["classes"], WORD_NOISE)) + np.arange(self.v["classes"])[:, None], side="right")
        u_n, shift = word_out[picks], (word_bias - self.log_word)[picks]
        u_t = word_out[word]
        f_t = (sigmoid(np.einsum("ij,ij->i", r_own, u_t) + (word_bias - self.log_word)[word]) - 1) / n
        f_n = np.empty((len(word), WORD_NOISE), np.float32)
        for c, i, j in spans:
            np.matmul(r_own[i:j], u_n[c].T, out=f_n[i:j])
            f_n[i:j] += shift[c]
        f_n = sigmoid(f_n) / n
        g_own = f_t[:, None] * u_t
        g_noise = np.zeros((*picks.shape, DIM + 1), np.float32)
        for c, i, j in spans:
            g_own[i:j] += f_n[i:j] @ u_n[c]
            g_noise[c, :, :DIM] = f_n[i:j].T @ r_own[i:j]
            g_noise[c, :, DIM] = f_n[i:j].sum(axis=0)
        g_r[skip:] += g_own
        word_outs = added(np.concatenate([word, picks[used].ravel()]),
                          np.concatenate([np.concatenate([f_t[:, None] * r_own, f_t[:, None]], axis=1), g_noise[used].reshape(-1, DIM + 1)]))
        g_all = np.zeros_like(r_all)
        g_all[at] = g_r
        g_features, g_position = np.zeros_like(features), np.empty_like(position)
        for i in range(CONTEXT):
            g_features[before(i, b - a)] += g_all * position[i]
            g_position[i] = np.einsum("ij,ij->j", g_all, features[before(i, b - a)])
        self.update(1, slice(None), g_position)
        self.update(0, *added(x.context[a - CONTEXT:b], g_features))
        for k, (rows, g) in ((2, outs), (4, word_outs)):
            self.update(k, rows, g[:, :DIM])
            self.update(k + 1, rows, g[:, DIM])


def train(texts: DataFrame, shared) -> list[np.ndarray]:
    """Parameters averaged over the partitions of ``texts``, by tokens."""
    start = start_parameters(shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, trainer, seen = shared.value, None, 0
        for batch in slices(batches):
            trainer = trainer or Trainer(v, 3)
            x = Encoded(batch.column(0), v)
            trainer.learn(x)
            seen += len(x.at)
        if seen:
            flat = np.concatenate([x.ravel() for x in trainer.p])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["p", "n"])

    def add(a, b):
        return a[0] + b[0], a[1] + b[1]

    nothing = (np.zeros(sum(x.size for x in start)), 0)
    done = (texts.mapInArrow(run, "p binary, n long").rdd
            .map(lambda r: (np.frombuffer(r[0], np.float32).astype(np.float64) * r[1], r[1])).treeAggregate(nothing, add, add, depth=3))
    if not done[1]:
        return start
    flat, out, at = (done[0] / done[1]).astype(np.float32), [], 0
    for x in start:
        out.append(flat[at:at + x.size].reshape(x.shape))
        at += x.size
    return out


def by_class(cls: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(class, places) of the classes that occur."""
    order = sorting(cls)
    cuts = np.flatnonzero(np.diff(cls[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(cls[places[0]]), places


def log_softmax(r: np.ndarray, out: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log of the target's share in a softmax over all of ``out``, by blocks that fit a cache."""
    result = np.empty(len(r))
    turned = np.ascontiguousarray(out.T)
    for i in range(0, len(r), BLOCK):
        s = r[i:i + BLOCK] @ turned
        s += bias
        own = s[np.arange(len(s)), target[i:i + BLOCK]].astype(np.float64)
        with np.errstate(over="ignore"):
            np.exp(s, out=s)
        total = s @ np.ones(s.shape[1], np.float32)
        if not (np.isfinite(total).all() and total.min() > 1e-30):  # beyond the range of floats: again, from each row's largest
            s = r[i:i + BLOCK] @ turned + bias
            top = s.max(axis=1)
            total, own = np.exp(s - top[:, None]).sum(axis=1), own - top
        result[i:i + BLOCK] = own - np.log(total, dtype=np.float64)
    return result


def token_log10(x: Encoded, p: list[np.ndarray], side: int) -> np.ndarray:
    """log10 P(class | context), for words times P(word | class, context), at every token, 0 at pads."""
    words, position, out, bias, word_out, word_bias = p
    result = np.zeros(len(x.cls))
    for a in range(CONTEXT, len(x.cls), CHUNK):
        _, r = predicted(x, a, min(a + CHUNK, len(x.cls)), words, position)
        at = np.flatnonzero(x.cls[a:a + CHUNK] >= 0)
        r, at = r[at], at + a
        log = log_softmax(r, out, bias, x.cls[at])
        own = np.flatnonzero(x.word[at] >= 0)
        word = x.word[at[own]]
        for c, places in by_class(word // side):
            of = slice(c * side, (c + 1) * side)
            log[own[places]] += log_softmax(r[own[places]], word_out[of], word_bias[of], word[places] - c * side)
        result[at] = log / np.log(10)
    return result


# ---------------------------------------------------------------- scores
def score(docs: DataFrame, in_training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens,
    base_score and score."""
    spark = docs.sparkSession
    training = docs.where(in_training).select(F.col(text).alias("text"))
    counts = saved(count_tokens(training))
    vocabulary = Vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary.shared())
    parameters = spark.sparkContext.broadcast(train(training, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value, parameters.value
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            x = Encoded(batch.column(3), v)
            head, safe = x.number >= 0, np.maximum(x.number, 0)
            model = token_log10(x, p, v["side"]) + np.where(head, v["inside"][safe], 0.0)
            sums = [np.add.reduceat(y, x.start) for y in (model, np.where(head, v["base"][safe], 0.0), (head & v["known"][safe]).astype(np.int64))]
            # other tokens of each text with their counts
            t = pa.table({"row": x.rare_row, "token": x.rare, "mark": x.rare_mark}).group_by(["row", "token", "mark"], use_threads=False).aggregate(
                [([], "count_all")]).sort_by("row").combine_chunks()
            offsets = pa.array(np.searchsorted(t["row"].to_numpy(), np.arange(batch.num_rows + 1)), pa.int32())

            def lists(column):
                values = t[column].combine_chunks() if t.num_rows else pa.array([], t.schema.field(column).type)
                return pa.ListArray.from_arrays(offsets, values.chunk(0) if isinstance(values, pa.ChunkedArray) else values)

            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x.n_tokens, pa.int64()), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0]),
                                              lists("token"), lists("mark"), lists("count_all")],
                                             ["rk", "id", "held", "n_tokens", "known", "base", "model", "token", "mark", "n"])

    src = docs.select(F.monotonically_increasing_id().alias("rk"), F.col(doc_id).cast("long").alias("id"), (~in_training).alias("held"),
                      F.col(text).alias("text"))
    rows = saved(src.mapInArrow(run, "rk long, id long, held boolean, n_tokens long, known long, base double, model double, "
                                     "token array<binary>, mark array<long>, n array<long>"))
    n_plus = float(vocabulary.total + vocabulary.distinct + 1)
    classes = spark.createDataFrame([(c, float(n), float(v)) for c, (n, v) in enumerate(zip(vocabulary.rare_n, vocabulary.rare_v))],
                                    "cls int, class_n double, class_v double")
    rare = rows.select("rk", F.explode(F.arrays_zip("token", "mark", "n")).alias("r")).select(
        "rk", "r.token", (F.col("r.mark") % vocabulary.rare).cast("int").alias("cls"), "r.n")
    rare = rare.join(vocabulary.tail.select("token", F.col("n").alias("count")), "token", "left").join(F.broadcast(classes), "cls")
    seen = F.coalesce("count", F.lit(0))
    inside = F.when(seen > 0, (seen - DISCOUNT) / (F.col("class_n") + 1)).otherwise((F.col("class_v") * DISCOUNT + 1) / (F.col("class_n") + 1))
    rare = rare.groupBy("rk").agg(F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("known2"),
                                  F.sum(F.col("n") * F.log10((seen + 1) / F.lit(n_plus))).alias("base2"),
                                  F.sum(F.col("n") * F.log10(inside)).alias("model2"))
    zero = F.lit(0.0)
    out = rows.drop("token", "mark", "n").join(rare, "rk", "left")
    return out.select(F.col("id").alias(doc_id), F.col("held").alias("held_out"), "n_tokens",
                      (F.col("known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"),
                      F.lit(vocabulary.total).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), (F.col("model") + F.coalesce("model2", zero)).alias("score"))
