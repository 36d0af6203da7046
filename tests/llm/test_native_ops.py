"""Operators 2, 3, 7 and 8 against brute force and their edge cases."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F
from proofsheet.llm import decontam, licenses, mixing, sharding
from proofsheet.llm.queries import DOMAINS, MIX_WEIGHTS, mix_levels

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


DOCS = "doc_id long, text string, n_words string, shard string, `odd name` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "mine", "mine", 1) for i, t in rows], DOCS)


# ---------------------------------------------------------------- op7
def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2.0 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_loop(spark):
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63] + [random.Random(3).randrange(-2 ** 63, 2 ** 63) for _ in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 100, 300):
        got = df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
        assert all(r["s"] == jump(r["k"] % 2 ** 64, n) for r in got)


def test_shard_index_moves_rows_only_into_the_new_shard(spark):
    rows = [(i, f"Täxt {i % 7}" if i % 5 else None) for i in range(400)] + [(None, "x"), (None, None), (7, "again"), (7, "again")]
    out = sharding.shard_index(docs(spark, rows).repartition(5), 16).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r["grown_shard"] == 16 for r in out)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["size"] == len("Täxt 1".encode()) + 1 and by_id[0]["size"] == 1
    assert by_id[1]["text_crc32"] == zlib.crc32("Täxt 1".encode()) and by_id[0]["text_crc32"] == 0
    assert len({r["shard"] for r in out if r["doc_id"] == 7}) == 1
    assert sharding.shard_index(docs(spark, []), 16).count() == 0
    kept = sharding.assign_shards(docs(spark, rows), 4)
    assert kept.columns.count("shard") == 1 and dict(kept.dtypes)["shard"] == "int"


# ---------------------------------------------------------------- op3
def brute_decontam(documents, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[s:s + n]), set()).add(str(item))
    out = []
    for i, text in documents:
        w, hit, got = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in wins:
                    hit |= set(range(s, s + n))
                    got |= wins[k]
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


def check_decontam(spark, documents, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.decontaminate(docs(spark, documents), bench).collect()]
    key = repr
    assert sorted(got, key=key) == sorted(brute_decontam(documents, items), key=key)


def random_texts(seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "Ä", "d9"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 4, 5, 6, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, "!!"), (None, "a b c a b c a b c a b c")]
    documents = [(i, "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n"]) for _ in range(rnd.choice([0, 1, 3, 12, 60])))) for i in range(30)]
    documents += [(100 + i, "x, " * i + items[i][1].upper().replace("Ä", "Ä") + " y") for i in range(12)]
    documents += [(0, documents[0][1]), (None, items[8][1]), (500, None), (501, "z " * 3000 + items[11][1])]
    return documents, [x for x in items if x[0] is not None]


def test_decontaminate_against_brute_force(spark):
    check_decontam(spark, *random_texts(1))
    check_decontam(spark, *random_texts(2))


def test_decontaminate_in_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 20)
    check_decontam(spark, *random_texts(3))
    monkeypatch.undo()
    documents, items = random_texts(4)
    check_decontam(spark, documents, [])
    assert decontam.decontaminate(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- op2
def brute_license(text):
    w = words(text)
    padded = " " + " ".join(w) + " "
    starts, base = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    found = []
    for r in licenses.RULES:
        if " " + r.keyword in padded:
            for m in re.finditer(r.pattern, padded):
                first = padded[:m.start()].count(" ")
                found.append((first, first + m.group().count(" ") - 1, r.priority, r.label, r.confidence))
    kept = []
    for k, d in enumerate(found):
        def beats(j, e):
            inside = e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
            if not inside:
                return False
            if (e[0], e[1], e[2]) != (d[0], d[1], d[2]):
                return True
            return (e[3], e[4], j) < (d[3], d[4], k)
        if not any(beats(j, e) for j, e in enumerate(found) if j != k):
            kept.append(d)
    labels = base | {d[3] for d in kept}
    return (len(w), len(starts), min(starts) if starts else None, max(starts) if starts else None, ",".join(sorted(base)),
            ",".join(sorted(labels)), max([d[4] for d in kept], default=0.0))


def test_license_scan_against_brute_force(spark):
    assert len(licenses.RULES) >= 200
    texts = [None, "", "...", "cc by", "CC-BY CC BY cc by-sa 4.0", "All rights reserved. all rights reserved",
             "GNU General Public License version 3 or any later version", "under the GNU Lesser General Public License v2.1.",
             "https://creativecommons.org/licenses/by-nc-sa/4.0/ Creative Commons Attribution-ShareAlike 3.0 Unported",
             "Released under the MIT License. Copyright (c) 2020 Ü. All rights reserved.", "SPDX-License-Identifier: Apache-2.0",
             "Permission is hereby granted, free of charge, to any person obtaining a copy", "the public domain public domain",
             "neither the name of the holder nor the names of its contributors", "gpl 3 only gpl v3", "x " * 5000 + "cc by " * 50,
             "terms and conditions may not be reproduced without prior written permission", "MIT license BSD license ISC licence", "cc byx xcc by",
             "Licensed under the Apache License, Version 2.0 (the License); apache.org/licenses/LICENSE-2.0"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "cc by"), (None, "cc by")]
    out = licenses.scan_licenses(docs(spark, rows))
    assert out.columns.count("n_words") == 1
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = {(r["doc_id"], r["text"]): tuple(r[n] for n in names) for r in out.collect()}
    for i, t in rows:
        assert got[(i, t)] == brute_license(t), (i, t, got[(i, t)], brute_license(t))
    assert out.count() == len(rows)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_license_scan_of_long_texts_in_blocks(spark, monkeypatch):
    lines = ["gnu general public license version 3 or at your option any later version", "cc by nc sa 4 0", "all rights reserved", "the mit license",
             "no part of this may be reproduced without prior written permission", "provided as is", "x y z"]
    rows = [(i, " ".join(lines[(i * j + j // 7) % 7] for j in range(250))) for i in range(1, 5)]
    for width in (1, licenses.BLOCK_WORDS):  # 1: blocks as narrow as the longest detection allows
        monkeypatch.setattr(licenses, "BLOCK_WORDS", width)
        for r in licenses.scan_licenses(docs(spark, rows)).collect():
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == brute_license(r["text"])
            assert [d["first"] for d in r["detections"]] == sorted(d["first"] for d in r["detections"])
            assert len(r["detections"]) > 100


# ---------------------------------------------------------------- op8
def fill(budget, children):
    """children: {name: (weight, cap)}; repeated rounds: give by weight, fill up, share the rest again."""
    got, open_ = dict.fromkeys(children, 0.0), {k for k, (w, c) in children.items() if w > 0}
    while open_ and budget > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] - got[k] <= budget * children[k][0] / total + 1e-12}
        if not full:
            for k in open_:
                got[k] += budget * children[k][0] / total
            break
        for k in full:
            budget -= children[k][1] - got[k]
            got[k] = children[k][1]
        open_ -= full
    return got


def brute_mix(rows, budget_share, max_epochs, seed):
    """rows: (id, text, lang, source); the (id, epoch) pairs that the mixture takes."""
    tokens = [len((t or "").split()) for _, t, _, _ in rows]

    def domain(src):
        m = re.fullmatch("src([0-9]{1,9})", src or "")
        return DOMAINS[int(m[1]) % len(DOMAINS)] if m else "other"

    leaves = {}
    for (i, _, lang, src), n in zip(rows, tokens):
        leaves.setdefault((domain(src), lang or "(null)", src or "(null)"), []).append((i, n))
    cap = {k: max_epochs * sum(n for _, n in v) for k, v in leaves.items()}
    weight = lambda k, i: MIX_WEIGHTS[i][0].get(k, MIX_WEIGHTS[i][1])
    budget = {(): float(int(budget_share * sum(tokens)))}
    for depth in range(3):
        for parent, b in [(p, b) for p, b in budget.items() if len(p) == depth]:
            kids = {k[depth] for k in cap if k[:depth] == parent}
            shares = fill(b, {c: (weight(c, depth), sum(v for k, v in cap.items() if k[:depth + 1] == (*parent, c))) for c in kids})
            budget |= {(*parent, c): s for c, s in shares.items()}
    want = []
    for leaf, members in leaves.items():
        target, avail = int(budget[leaf] + 1e-6), sum(n for _, n in members)
        full = target // avail if avail else 0
        want += [(i, e) for i, _ in members for e in range(full)]
        rest = target - full * avail if avail else 0
        h = lambda i: hashlib.md5(f"{seed}:{full}:{'' if i is None else i}".encode()).hexdigest()
        run = 0
        for x in sorted({h(i) for i, _ in members}) if rest else []:
            run += sum(n for i, n in members if h(i) == x)
            if run > rest:
                break
            want += [(i, full) for i, _ in members if h(i) == x]
    return want


def test_mixing_fills_siblings_before_ancestors(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * rnd.randrange(0, 30)), rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "src5", None])) for i in range(300)]
    rows += [(i, "a b c", "en", "src0") for i in range(5)] + [(900, None, "en", "src1"), (901, "  \n", "de", "src0")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, epoch int")
    out = mixing.mix(df, mix_levels(), MIX_WEIGHTS, budget_share=0.7, max_epochs=2, seed=3).collect()
    assert sorted((r["doc_id"], r["epoch"]) for r in out) == sorted(brute_mix(rows, 0.7, 2, 3))
    assert mixing.mix(df.limit(0), mix_levels(), MIX_WEIGHTS, 0.5).count() == 0


def test_mixing_with_more_leaves_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    rows = [(i, "w " * (i % 13), "en", "src0" if i % 3 else f"src{i}") for i in range(400)] + [(5, "a b c", "en", "src0")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, mix_levels(), MIX_WEIGHTS, budget_share=0.6, max_epochs=2, seed=3)
    assert sorted((r["doc_id"], r["epoch"]) for r in out.collect()) == sorted(brute_mix(rows, 0.6, 2, 3))
    assert "__salt" not in out.columns
    assert "Broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_mixing_gives_on_what_zero_weights_cannot_place(spark):
    leaves = spark.createDataFrame([("A", "x", 10, 1), ("A", "y", 100, 1), ("B", "x", 100, 1)], "a string, b string, available long, n_docs long")
    weights = [({}, 1.0), ({"y": 0.0}, 1.0)]
    got = {(r["a"], r["b"]): r["target"] for r in mixing.budgets(leaves, ["a", "b"], weights, 0.5, 1).collect()}
    assert got == {("A", "x"): 10, ("A", "y"): 0, ("B", "x"): 95}
