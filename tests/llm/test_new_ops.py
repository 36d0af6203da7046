"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proofsheet.llm import centroids, packing, spelling

SF = "/root/testdata/sf0.001"
CLASH = "cluster string, word string, sequence_id string, key string, part string"


# ---------------------------------------------------------------- op11
def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c[j])), j) for j in range(len(c)))

    for _ in range(rounds):
        who = [nearest(v)[1] for _, v in kept]
        c = [[sum(col) // len(mine) for col in zip(*mine)] if (mine := [v for (_, v), w in zip(kept, who) if w == j]) else c[j] for j in range(len(c))]
    near = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, w in near if w == j) for j in range(len(c))]
    return sorted(((i if i is not None else -1), j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                  for (i, _), (d, j) in zip(kept, near))


def clusters(spark, rows):
    df = spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], f"vec_id long, embedding array<float>, {CLASH}")
    out = centroids.cluster(df.repartition(3)).drop("centroid").collect()
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in out)


def test_clusters_equal_brute_force(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(i % 5, 0.6, 64)]) for i in range(120)]
    rows += [(7, rows[7][1])] * 30  # a vector that many rows repeat
    rows += [(500, None), (501, []), (502, [0.5] * 63), (503, [None] + [0.1] * 63), (504, [float("nan")] * 64),
             (505, [float("inf")] + [0.0] * 63), (None, [0.25] * 64), (506, [0.0] * 64), (507, [-0.0] * 64)]
    assert clusters(spark, rows) == brute_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert clusters(spark, rows) == brute_clusters(rows)


def test_threshold_walk_is_exact_and_stops_early():
    rnd = np.random.default_rng(2)
    for d, k in ((1, 40), (2, 60), (3, 7), (64, 8)):
        c, v = rnd.integers(-50, 50, (k, d)), rnd.integers(-60, 60, (500, d))
        who, best, exact = centroids.Lists(c).nearest(v)
        all_ = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (who == all_.argmin(1)).all() and (best == all_.min(1)).all()
        if k >= 40:
            assert exact < 500 * k / 2  # most centroids are never met


def test_equal_distances_go_to_the_smaller_number():
    c = np.array([[4, 0], [0, 4], [-4, 0], [0, -4], [4, 0]])
    who, best, _ = centroids.Lists(c).nearest(np.array([[0, 0], [4, 0], [1, 1], [-1, -1]]))
    assert who.tolist() == [0, 0, 0, 2] and best.tolist() == [16, 0, 10, 10]


def test_integers_out_of_range_are_named(spark):
    with pytest.raises(Exception, match="lies beyond"):
        clusters(spark, [(1, [1e30] * 64)])


# ---------------------------------------------------------------- op12
def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute_variants(words):
    out = {}
    for w, n in words.items():
        near = [u for u in words if one_error(w, u)]
        form = min(near, key=lambda u: (-words[u], u), default=None)
        out[w] = (form if form and words[form] >= 2 * n else None, n, len(near))
    result = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.append((w, form, root, n, near, words[form] if form else None))
    return sorted(result)


def misspelt(seed, words=60, docs=80):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcäñ", k=rnd.randrange(4, 9))) for _ in range(words)]
    rows = []
    for i in range(docs):
        text = []
        for w in rnd.choices(vocab, k=40):
            if rnd.random() < 0.3:
                at, c = rnd.randrange(len(w)), rnd.choice("abcäñ")
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]])
            text.append(w if rnd.random() < 0.8 else w.upper())
        rows.append((i, " ".join(text)))
    return rows


def found_variants(spark, rows):
    df = spark.createDataFrame([(i, t, *["x"] * 5) for i, t in rows], f"doc_id long, text string, {CLASH}")
    return sorted(map(tuple, spelling.variants(df).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("shard, block", [(1 << 14, 1 << 16), (16, 8)])
def test_variants_equal_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "QUERY_ROWS", block)
    rows = misspelt(1, 40, 200) + [(907, "kette " * 12 + "ketten " * 6 + "kettens " * 3), (None, "héllo héllo héllo hélloo hélloo hélloo hélloo hélloo hélloo"), (900, None), (901, ""), (902, "\n 1 2 ."),
                          (903, "straße × ÷ " * 6), (903, "straße × ÷ " * 6), (904, "x" * 3000 + " " + "x" * 3001), (905, ("x" * 3000 + " ") * 3), (906, ("x" * 3001 + " ") * 7)]
    expected = brute_variants(brute_words(rows))
    assert found_variants(spark, rows) == expected
    assert sum(r[4] for r in expected) > 80 and any(r[2] not in (r[0], r[1]) for r in expected)  # chains of forms


def test_variants_of_nothing(spark):
    assert found_variants(spark, []) == [] and found_variants(spark, [(1, None)]) == []


def test_near_words_of_a_common_beginning(spark, monkeypatch):
    """All words begin alike: their shards are asked by many and go out in blocks."""
    monkeypatch.setattr(spelling, "SHARD_WORDS", 32)
    monkeypatch.setattr(spelling, "QUERY_ROWS", 64)
    rnd = random.Random(3)
    words = {"commonstart" + "".join(rnd.choices("ab", k=rnd.randrange(0, 10))): rnd.randrange(3, 50) for _ in range(400)}
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {r["word"]: r["n_near"] for r in got.collect()} == {w: k for w in words if (k := sum(one_error(w, u) for u in words))}


def test_suffix_array_and_both_extensions():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choices("abc", k=rnd.randrange(1, 12))) for _ in range(60)})
    index = spelling.Index(words)
    text = "\1" + "\1".join(words) + "\1" + "\0"
    assert index.order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for w in words[::7]:
        code = index.encode(w)
        mid = len(w) // 2
        low, size = [np.zeros(1, int), np.zeros(1, int)], np.array([index.size])
        for c in code[mid:]:
            low, size = index.extend(1, low, size, np.array([c]))
        for c in code[:mid][::-1]:
            low, size = index.extend(0, low, size, np.array([c]))
        assert size[0] == sum(text.startswith(w, i) for i in range(len(text)))
        assert all(text.startswith(w, index.order[low[0][0] + i]) for i in range(size[0]))


# ---------------------------------------------------------------- op13
def check_plan(counts, capacity):
    plan = packing.Plan(dict(counts), capacity)
    sequences = defaultdict(list)
    for length, rank, ranks, first, pieces, offset in plan.runs:
        for i in range(ranks):
            sequences[first + i // pieces].append((offset + i % pieces * length, length))
        if ranks:
            seq, off = plan.places(np.array([length]), np.array([rank + ranks - 1]))
            assert (seq[0], off[0]) == (first + (ranks - 1) // pieces, offset + (ranks - 1) % pieces * length)
    for (length, _), parts in plan.cuts.items():
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist() and sum(p[1] for p in parts) == length
        for _, size, seq, off in parts:
            sequences[seq].append((off, size))
    assert sorted(sequences) == list(range(plan.sequences))
    short = 0
    for parts in sequences.values():
        end = 0
        for off, size in sorted(parts):
            assert off == end
            end += size
        assert end == capacity or end & (end - 1) == 0
        short += end < capacity
    assert short <= capacity.bit_length()
    assert sum(s for p in sequences.values() for _, s in p) == sum(x * n for x, n in counts.items())
    return plan


def test_plans_fill_every_window():
    rnd = random.Random(1)
    for _ in range(200):
        capacity = rnd.choice([8, 16, 64])
        check_plan({x: rnd.randrange(0, 6) for x in range(1, capacity) if rnd.random() < 0.5}, capacity)
    check_plan({1500: 40}, 2048)  # nothing fits beside these: every window cuts one
    plan = check_plan({1: 4096, 2047: 4096}, 2048)
    assert len(plan.runs) == 2 and not plan.cuts  # one multiset, used as often as the counts allow


def test_closest_sum_is_the_largest_reachable():
    rnd = random.Random(2)
    for _ in range(300):
        counts = {rnd.randrange(1, 20): rnd.randrange(0, 4) for _ in range(5)}
        room, reach = rnd.randrange(0, 60), {0}
        for length, n in counts.items():
            reach = {a + length * i for a in reach for i in range(n + 1)}
        total, used = packing.closest_sum(counts, room)
        assert total == max(x for x in reach if x <= room) == sum(x * n for x, n in used.items())
        assert all(0 < n <= counts[x] for x, n in used.items())


def check_packing(spark, df, capacity=2048):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(df, path, capacity).collect()
    streams, sequences = Counter(), defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        streams[r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append((p["start"], bytes(p["ids"]), p["doc_tokens"]))
    for parts in sequences.values():
        end = 0
        for off, size in sorted(parts):
            assert off == end
            end += size
        assert end == capacity or end < capacity and end & (end - 1) == 0
    for (doc, stream), n in streams.items():
        mine = [(s, b) for s, b, t in by_doc[doc] if t * 4 == len(stream) and stream[4 * s:4 * s + len(b)] == b]
        assert sum(len(b) for _, b in mine) >= n * len(stream)
    assert sum(p["length"] for p in pieces) * 4 == sum(len(s) * n for (_, s), n in streams.items())
    for doc, parts in by_doc.items():
        if len({s for d, s in streams if d == doc}) == 1 and sum(n for (d, _), n in streams.items() if d == doc) == 1:
            parts.sort()
            assert b"".join(b for _, b, _ in parts) in {s for d, s in streams if d == doc}
    return sequences


@pytest.mark.parametrize("tokens", [1 << 23, 5000])
def test_packing_is_an_exact_cover(spark, monkeypatch, tokens):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(packing, "OUT_TOKENS", 3000)
    rows = [(i, "word " * (i * 37 % 900)) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "Ä"), (102, "Ä"), (None, "no id"), (None, None), (103, "long " * 30000), (104, "<|endoftext|>")] + [(105, "same")] * 40
    df = spark.createDataFrame([(i, t, *["x"] * 5) for i, t in rows], f"doc_id long, text string, {CLASH}")
    check_packing(spark, df.repartition(3), 256)


def test_both_encoders_agree():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = packing.Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert encoder.fast is not None
    rnd = random.Random(6)
    letters = [*"abc XYZ019'.,;<|>\n\t  _-äßñÿ\u00a0\u0085\u01c5", "<|endoftext|>", "\u3042", "\U0001F600", "'ll", "'s", "\u0300"]
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(0, 60))) for _ in range(3000)]
    assert sum(packing.PLAIN.fullmatch(t) is not None for t in texts) > 300
    assert [encoder.ids(t) for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()).fast is None


def test_packing_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    sequences = check_packing(spark, df)
    assert sum(sum(s for _, s in p) < 2048 for p in sequences.values()) <= 11


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_queries_of_the_new_operators(spark):
    from proofsheet.llm.queries import LLM_QUERIES
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    out = LLM_QUERIES["op13_packing"](spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.groupBy("doc_id").agg(F.sum("length").alias("s"), F.max("doc_tokens").alias("t")).where("s = t").count() == n
    assert LLM_QUERIES["op11_centroid_clusters"](spark, SF).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
