"""Operator 13: packing token streams into sequences by minimum bin slack.

One pass without a shuffle: a task tokenises its documents and packs them in
blocks of about BLOCK_TOKENS.  A document's ids and the end id are cut at
multiples of the capacity; whole pieces are sequences of their own, of the rest
(1 to capacity - 1 ids) the lengths are counted.  For every window the longest
remaining length is set, and a subset-sum dynamic programme over bitsets (bit
s: the sum s can be reached; counts by binary multiples) finds the multiset of
other remaining lengths that fills the window closest to capacity; counts come
back by walking the bitsets backwards.  A filled window is used as often as the
counts allow.  If no multiset fills a window, one more document is cut to fill
it, and the rest of that document opens the next window.  What is left of a
block in the end, less than a capacity, fills windows of falling powers of two,
which need no padding either: a sequence is full, or its length a power of two
and one of at most log2(capacity) such sequences of its block.

Sequence ids hold the number of the input partition above bit 40, so they are
unique and a lost task gives the same ones again, as long as its input partition
holds the same rows (a file scan does; write other input to a table first).

Defined results: null and empty texts are the end id alone; repeated rows are
packed each; an empty table gives no rows; a null id is an id like any other;
input columns other than id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proofsheet.llm.text import slices

CAPACITY, END_ID = 2048, 1
#: Tokens and documents packed together, about; bytes of text tokenised at once; tokens of one output batch.
BLOCK_TOKENS, BLOCK_ROWS, TEXT_BYTES, OUT_TOKENS = 1 << 23, 1 << 18, 1 << 20, 1 << 20


# ---------------------------------------------------------------- plan
def closest_sum(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most ``room`` that lengths with these counts reach, and how often each is in it.
    Lengths are taken from the longest on and only until ``room`` itself is reached."""
    mask, reach = (1 << room + 1) - 1, 1
    before: list[tuple[int, int]] = []  # (length, bitset before it)
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        before.append((length, reach))
        n, step = min(counts[length], room // length), 1
        while n > 0:
            take = min(step, n)
            reach |= reach << take * length & mask
            n, step = n - take, step * 2
        if reach >> room & 1:
            break
    total = left = reach.bit_length() - 1
    used = {}
    for length, bits in reversed(before):
        times = 0
        while not bits >> left & 1:
            left, times = left - length, times + 1
        if times:
            used[length] = times
    return total, used


class Plan:
    """Places of remaining lengths in sequences 0, 1, ..., from their counts.

    ``runs``: (length, first rank, ranks, first sequence, pieces a sequence,
    offset): ranks from ``first rank`` on fill ``pieces`` places of ``length``,
    from ``offset``, in every sequence from ``first sequence`` on.
    ``cuts``: (length, rank) to its pieces (start, length, sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {x: n for x, n in counts.items() if x and n}
        self.rank: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.cuts: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)
        self.sequences = 0
        self.open: tuple[int, int, int] | None = None  # a cut document's length, rank and start of what is left of it
        total = sum(x * n for x, n in self.left.items())
        while total >= capacity:
            total -= self.fill(capacity) * capacity
        for power in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
            self.fill(power)

    def take(self, length: int, ranks: int) -> int:
        first = self.rank[length]
        self.rank[length] += ranks
        self.left[length] -= ranks
        if not self.left[length]:
            del self.left[length]
        return first

    def piece(self, size: int, offset: int) -> None:
        """``size`` ids of the open document go to the present window."""
        length, rank, start = self.open
        self.cuts[length, rank].append((start, size, self.sequences, offset))
        self.open = (length, rank, start + size) if start + size < length else None

    def fill(self, capacity: int) -> int:
        """Fills one window, or several alike; their number."""
        at, chosen = 0, {}
        if self.open:
            at = min(self.open[0] - self.open[2], capacity)
            self.piece(at, 0)
            total, chosen = closest_sum(self.left, capacity - at)
        else:
            longest = max((x for x in self.left if x <= capacity), default=0)
            rest = {**self.left, longest: self.left[longest] - 1} if longest else {}
            total, chosen = closest_sum(rest, capacity - longest)
            if longest:
                total, chosen[longest] = total + longest, chosen.get(longest, 0) + 1
        slack = capacity - at - total
        times = 1 if at or slack else min(self.left[x] // m for x, m in chosen.items())
        for length, m in sorted(chosen.items(), reverse=True):
            self.runs.append((length, self.take(length, m * times), m * times, self.sequences, m, at))
            at += m * length
        if slack:  # every length left is longer than the slack, or it would be in the sum
            longest = max(self.left)
            self.open = (longest, self.take(longest, 1), 0)
            self.piece(slack, at)
        self.sequences += times
        return times

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of whole remaining lengths by rank."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        # one key for (length, rank): lengths stay below 2^20, ranks below 2^43
        run = runs[np.searchsorted(runs[:, 0] << 43 | runs[:, 1], length << 43 | rank, side="right") - 1]
        nth = rank - run[:, 1]
        return run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * length


# ---------------------------------------------------------------- tokens
#: FIXED VALUE: how byte-level BPE splits a text before its merges.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every Unicode version classes alike; with them "<|" begins a special token.
PLAIN, SPECIAL = re.compile(r"[\0-\u024F]*"), "<|"


def merge_ranks(vocabulary: dict) -> dict[bytes, int] | None:
    """The ranks of a plain byte-level BPE file, or None if the file asks for more than merges in the order of the ids."""
    model, split = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if vocabulary.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes written as themselves, others from 256 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    special = {t["content"] for t in vocabulary.get("added_tokens", [])}
    if not all(t.startswith(SPECIAL) for t in special):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class Encoder:
    """Token ids as the library ``tokenizers`` gives them for a vocabulary file.
    For plain byte-level BPE the same merges run in ``tiktoken``, which takes a
    third of the time, on all texts whose characters both split alike."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # every core has a task of its own
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        ranks = merge_ranks(json.loads(tokenizer_json))
        self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def ids(self, text: str) -> list[int]:
        if self.fast and SPECIAL not in text and (text.isascii() or PLAIN.fullmatch(text)):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- tasks
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray], capacity: int, first: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a block in the order of their sequences, numbered from ``first``; the number of sequences is returned."""
    n = np.array([len(x) for x in ids])
    whole, rest = n // capacity, n % capacity
    row = np.repeat(np.arange(len(n)), whole)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
    ends = np.flatnonzero(rest)
    ends = ends[np.argsort(rest[ends], kind="stable")]
    sizes, at, counts = np.unique(rest[ends], return_index=True, return_counts=True)
    rank = np.arange(len(ends)) - np.repeat(at, counts)
    plan = Plan(dict(zip(sizes.tolist(), counts.tolist())), capacity)
    cut = np.array([key in plan.cuts for key in zip(rest[ends].tolist(), rank.tolist())], bool)
    parts = [(r, int(whole[r]) * capacity + s, size, sequence, offset) for r, key in
             ((int(ends[i]), (int(rest[ends[i]]), int(rank[i]))) for i in np.flatnonzero(cut)) for s, size, sequence, offset in plan.cuts[key]]
    cuts = np.array(parts, np.int64).reshape(-1, 5)
    ends, rank = ends[~cut], rank[~cut]
    sequence, offset = plan.places(rest[ends], rank)
    row = np.concatenate([row, ends, cuts[:, 0]])
    start = np.concatenate([start, whole[ends] * capacity, cuts[:, 1]])
    sequences = plan.sequences + len(row) - len(ends) - len(cuts)
    sequence = np.concatenate([plan.sequences + np.arange(len(row) - len(ends) - len(cuts)), sequence, cuts[:, 3]])
    offset = np.concatenate([np.zeros(len(row) - len(ends) - len(cuts), np.int64), offset, cuts[:, 4]])
    length = np.concatenate([np.full(len(row) - len(ends) - len(cuts), capacity), rest[ends], cuts[:, 2]])
    order = np.lexsort([offset, sequence])
    full = np.cumsum(length[order]) // OUT_TOKENS
    for some in np.split(order, np.flatnonzero(np.diff(full)) + 1):
        data = [ids[r][s:s + size].tobytes() for r, s, size in zip(row[some].tolist(), start[some].tolist(), length[some].tolist())]
        columns = [start[some], length[some], n[row[some]], first + sequence[some], offset[some]]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([doc_ids[r] for r in row[some].tolist()], pa.int64()), *arrays[:2], pa.array(data, pa.binary()), *arrays[2:]],
                                         ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit
    little-endian), doc_tokens, sequence_id and offset.  ``tokenizer_path`` is
    read by the driver and broadcast: a vocabulary file of a few MB."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        first, tokens = TaskContext.get().partitionId() << 40, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        for batch in slices(batches, size=TEXT_BYTES):
            for text in batch.column(1).to_pylist():
                own = encoder.ids(text or "")
                own.append(end_id)
                ids.append(np.array(own, "<u4"))
                tokens += len(own)
            doc_ids += batch.column(0).to_pylist()
            if tokens > BLOCK_TOKENS or len(ids) > BLOCK_ROWS:
                first += yield from pack_block(doc_ids, ids, capacity, first)
                doc_ids, ids, tokens = [], [], 0
        if ids:
            yield from pack_block(doc_ids, ids, capacity, first)

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, PIECE)
