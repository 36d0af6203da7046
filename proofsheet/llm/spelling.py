"""Operator 12: spelling variants, found by search schemes in bidirectional FM-indexes.

Words and their counts are native DataFrame work.  The distinct words are cut
into shards of about SHARD_WORDS that are contiguous in word order, and, for
the second scheme, into shards contiguous in the order of the reversed words.
A task holds one shard: the delimited text of its words, the suffix arrays of
that text and of its reverse, and sampled ranks over both transforms, so that
a pattern's suffix-rank interval can be extended on either side.

Search schemes: a word w = AB with one error in it keeps A or keeps B.  The
first scheme matches the delimiter and A exactly and extends over B and the
delimiter allowing one error; it finds the near words that begin with A.  The
second does the same with reversed words, from B over A, and leaves out what
begins with A; so each near word is found once.  A word asks only the shards
that its exact half reaches, a contiguous range of them.  Shards that many
words ask are sent out several times, each copy with a block of at most about
QUERY_ROWS askers, so no task grows with a hot beginning.

Defined results: a null text has no words, a null id counts as ''; repeated
rows are counted each; an empty table gives no rows; of near words with equal
counts the smallest in code-point order is the form; input columns other than
id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm.text import lower_ascii
from proofsheet.session import saved

MIN_LETTERS, MIN_COUNT, DROP_OUT_OF = 5, 3, 97
#: Words of a shard, about; queries of a block, about.
SHARD_WORDS, QUERY_ROWS = 1 << 14, 1 << 16
#: Queries searched at once, letters of them at most, and symbols between sampled ranks.
BATCH, LETTERS, STEP = 2048, 1 << 18, 64
END, MARK = 0, 1  # symbols of the text's end and of the delimiter


# ---------------------------------------------------------------- words
def dropped_letter(doc_id: Column, run: Column) -> Column:
    """The run without one letter where its hash is divisible by DROP_OUT_OF."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % DROP_OUT_OF == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words with MIN_LETTERS code points and MIN_COUNT occurrences.
    Shorter runs cannot give a word, so only longer ones are taken out of the text."""
    runs = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"([a-zÀ-ÿ]{{{MIN_LETTERS},}})"), F.lit(1))
    each = docs.select(F.col(doc_id).alias("id"), F.explode(runs).alias("run"))
    words = each.select(dropped_letter(F.col("id"), F.col("run")).alias("word")).where(F.char_length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- index
def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start of the suffixes in order, by prefix doubling; the last symbol is the only smallest one."""
    n, bits = len(t), max(1, int(t.max()).bit_length())
    width = 62 // bits
    rank = np.zeros(n, np.int64)
    padded = np.concatenate([t.astype(np.int64), np.zeros(width, np.int64)])
    for j in range(width):
        rank = rank << bits | padded[j:j + n]
    while True:
        order = np.argsort(rank, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(rank[order]) != 0)])
        rank[order] = step
        if step[-1] == n - 1:
            return order
        rank = rank * (n + 1) + np.concatenate([rank[width:] + 1, np.zeros(min(width, n), np.int64)])[:n]
        width *= 2


class Ranks:
    """Numbers of symbols in beginnings of a transform, sampled every STEP symbols."""

    def __init__(self, transform: np.ndarray, symbols: int):
        n, blocks = len(transform), len(transform) // STEP + 1
        cells = np.bincount(np.arange(n) // STEP * symbols + transform, minlength=blocks * symbols).reshape(blocks, symbols)
        before = np.concatenate([np.zeros((1, symbols), np.int64), np.cumsum(cells, axis=0)[:-1]])
        self.less = np.concatenate([np.zeros((blocks, 1), np.int64), np.cumsum(before, axis=1)], axis=1).astype(np.int32)
        self.block = np.concatenate([transform, np.zeros(blocks * STEP - n, transform.dtype)]).reshape(blocks, STEP)

    def less_and_equal(self, c: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the first i symbols: those smaller than c, and those equal to it."""
        b = i // STEP
        inside = self.block[b]
        valid = np.arange(STEP) < (i - b * STEP)[:, None]
        own = c[:, None].astype(inside.dtype)
        less = self.less[b, c] + np.count_nonzero((inside < own) & valid, axis=1)
        equal = self.less[b, c + 1] - self.less[b, c] + np.count_nonzero((inside == own) & valid, axis=1)
        return less, equal


class Index:
    """Bidirectional FM-index over the delimited text of distinct words.  A
    state is (low, low of the reverse, size): the suffix-rank intervals of a
    pattern and of its reverse."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)  # the delimiter first
        text = np.searchsorted(self.alphabet, points) + 1
        self.symbols = len(self.alphabet) + 1
        kind = np.uint8 if self.symbols < 256 else np.int32
        self.first = np.concatenate([[0, 1], 1 + np.cumsum(np.bincount(text, minlength=self.symbols)[1:])])
        forward = np.concatenate([text, [END]])
        self.order = suffix_array(forward)
        self.word_at = np.cumsum(forward == MARK) - 1
        backward = np.concatenate([text[::-1], [END]])
        self.transform = [forward[self.order - 1].astype(kind), backward[suffix_array(backward) - 1].astype(kind)]
        self.ranks = [Ranks(t, self.symbols) for t in self.transform]
        self.size = len(forward)

    def encode(self, word: str) -> np.ndarray:
        """Symbols of a word; -1 for code points that no word has."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1)

    def extend(self, side: int, low, size, c):
        """States after one more symbol c on a side (0 left, 1 right); low[side] is looked up, the other follows."""
        less0, equal0 = self.ranks[side].less_and_equal(c, low[side])
        less1, equal1 = self.ranks[side].less_and_equal(c, low[side] + size)
        new = [None, None]
        new[side] = self.first[c] + equal0
        new[1 - side] = low[1 - side] + less1 - less0
        return new, equal1 - equal0

    def next_symbols(self, low, size) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol): the letters that stand right of each state's pattern.
        Small intervals are read row by row, of others every letter is named."""
        small = np.flatnonzero(size <= self.symbols)
        reps = size[small]
        state = np.repeat(small, reps)
        within = np.arange(len(state)) - np.repeat(np.cumsum(reps) - reps, reps)
        symbol = self.transform[1][low[1][state] + within].astype(np.int64)
        pair = np.unique(state * self.symbols + symbol)
        large = np.flatnonzero(size > self.symbols)
        pair = np.concatenate([pair, (large[:, None] * self.symbols + np.arange(self.symbols)).ravel()])
        state, symbol = pair // self.symbols, pair % self.symbols
        return state[symbol > MARK], symbol[symbol > MARK]

    def near(self, words: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word number): indexed words that keep a query's first
        ``exact`` letters and have exactly one error in the others."""
        length = np.array([len(w) for w in words])
        half = np.array(exact)
        letters = np.full((len(words), int(length.max()) + 2), MARK)
        for i, w in enumerate(words):
            letters[i, :length[i]] = self.encode(w)
        # the exact half from its end to the delimiter before it
        q = np.arange(len(words))
        low, size = [np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)], np.full(len(q), self.size)
        for step in range(int(half.max()) + 1):
            on = np.flatnonzero(step <= half[q])
            c = np.where(step < half[q[on]], letters[q[on], np.maximum(half[q[on]] - 1 - step, 0)], MARK)
            new, more = self.extend(0, [x[on] for x in low], size[on], np.maximum(c, 0))
            low[0][on], low[1][on], size[on] = new[0], new[1], np.where(c < 0, 0, more)
            keep = size > 0
            q, low, size = q[keep], [x[keep] for x in low], size[keep]
            if not len(q):
                break
        pos, wrong = half[q], np.zeros(len(q), bool)
        found_q, found_w = [], []
        while len(q):
            own = letters[q, pos]
            # a letter left out: the last one of its run
            skip = np.flatnonzero(~wrong & (pos < length[q]) & (letters[q, pos + 1] != own))
            # a letter put in or replaced, by any that differs from the one due
            free = np.flatnonzero(~wrong)
            at, c = self.next_symbols([x[free] for x in low], size[free])
            at = free[at]
            other = c != own[at]
            at, c = at[other], c[other]
            go = np.flatnonzero(own >= 0)
            state = np.concatenate([go, at])
            new, more = self.extend(1, [x[state] for x in low], size[state], np.concatenate([own[go], c]))
            done = np.concatenate([pos[go] == length[q[go]], np.zeros(len(at), bool)]) & (more > 0)
            hit = done & wrong[state]
            found_q.append(q[state[hit]])
            found_w.append(self.word_at[self.order[new[0][hit]]])
            # after the letter due; after a letter put in (the one due stays); after a letter replaced
            plain = np.concatenate([np.ones(len(go), bool), np.zeros(len(at), bool)])
            live = (more > 0) & ~done
            a, b = live & plain, live & ~plain
            r = b & (pos[state] < length[q[state]])
            parts = [(state[a], [x[a] for x in new], more[a], 1, wrong[state[a]]), (state[b], [x[b] for x in new], more[b], 0, None),
                     (state[r], [x[r] for x in new], more[r], 1, None), (skip, [x[skip] for x in low], size[skip], 1, None)]
            wrong = np.concatenate([np.ones(len(p[0]), bool) if p[4] is None else p[4] for p in parts])
            pos = np.concatenate([pos[p[0]] + p[3] for p in parts])
            q = np.concatenate([q[p[0]] for p in parts])
            low = [np.concatenate([p[1][s] for p in parts]) for s in (0, 1)]
            size = np.concatenate([p[2] for p in parts])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_w])


# ---------------------------------------------------------------- shards
def exact_letters(word: str, scheme: int) -> int:
    return len(word) // 2 if scheme == 0 else len(word) - len(word) // 2


def routed(words: DataFrame, scheme: int) -> DataFrame:
    """(scheme, shard, key, n, own): each word (reversed in scheme 1) in its own
    shard and as a question to every shard that its exact half reaches."""
    key = F.col("word") if scheme == 0 else F.reverse("word")
    shards = max(1, -(-words.count() // SHARD_WORDS))
    ranged = saved(words.select(key.alias("key"), "n").repartitionByRange(shards, "key").withColumn("part", F.spark_partition_id()))
    # one row per shard: the vocabulary over SHARD_WORDS
    starts = sorted(r["start"] for r in ranged.groupBy("part").agg(F.min("key").alias("start")).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, at, own = [], [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                half = w[:exact_letters(w, scheme)]
                home = bisect_right(starts, w) - 1
                for s in range(max(0, bisect_right(starts, half) - 1), bisect_right(starts, half + chr(0x10FFFF))):
                    shard.append(s)
                    at.append(i)
                    own.append(s == home)
            yield pa.RecordBatch.from_arrays([pa.array([scheme] * len(at), pa.int32()), pa.array(shard, pa.int32()), batch.column(0).take(pa.array(at, pa.int64())),
                                              batch.column(1).take(pa.array(at, pa.int64())), pa.array(own, pa.bool_())], ["scheme", "shard", "key", "n", "own"])

    return ranged.select("key", "n").mapInArrow(run, "scheme int, shard int, key string, n long, own boolean")


def search_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form, form_n) of the words of one block of a shard."""
    scheme = int(rows["scheme"].iloc[0])
    indexed = rows[rows["index"]].sort_values("key")
    names, counts = indexed["key"].tolist(), indexed["n"].to_numpy()
    asked = sorted(rows.loc[~rows["index"], "key"].tolist(), key=len)  # words of like length together
    out: dict[str, tuple[int, int, str]] = {}
    index = Index(names) if names and asked else None
    while index and asked:
        # from the longest on; a word longer than LETTERS goes alone
        some = asked[-max(1, min(BATCH, LETTERS // len(asked[-1]))):]
        del asked[-len(some):]
        for q, w in zip(*(x.tolist() for x in index.near(some, [exact_letters(w, scheme) for w in some]))):
            word, near, n = some[q], names[w], int(counts[w])
            if scheme:
                word, near = word[::-1], near[::-1]
                if near.startswith(word[:len(word) // 2]):
                    continue  # the first scheme has it
            n_near, most, form = out.get(word, (0, 0, ""))
            if n > most or n == most and near < form:
                most, form = n, near
            out[word] = (n_near + 1, most, form)
    return pd.DataFrame([(w, a, f, m) for w, (a, m, f) in out.items()], columns=["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): of each of the distinct ``words`` (word, n)
    that has near ones, their number and the one of largest n."""
    visits = saved(routed(words, 0).unionByName(routed(words, 1)))
    asked = visits.groupBy("scheme", "shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    visits = visits.join(F.broadcast(asked), ["scheme", "shard"])  # two rows a shard
    questions = visits.select("scheme", "shard", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "n", F.lit(False).alias("index"))
    index = visits.where("own").select("scheme", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "n", F.lit(True).alias("index"))
    found = questions.unionByName(index).groupBy("scheme", "shard", "block").applyInPandas(
        search_shard, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word with a form.  Counts at
    least double from form to form, so chains are short; each round halves them."""
    to = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = saved(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not to.where("moved").limit(1).count():
            return to.drop("moved")
        to = to.drop("moved")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = saved(word_counts(docs, doc_id, text))
    near = saved(near_words(words))
    all_ = words.join(near, "word", "left").withColumn("form", F.when(F.col("form_n") >= 2 * F.col("n"), F.col("form")))
    forms = saved(all_)
    return forms.join(roots(forms.where(F.col("form").isNotNull())), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))
