"""Operators 1, 4, 5, 6, 9 and 10 against brute force, and their edge cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from proofsheet.llm import lm, nndescent, quality, simhash, toxicity, warc
from proofsheet.llm.text import held_out, token_bytes

DOCS = "doc_id long, text string, score string, component_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], DOCS)


def texts(n, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(5, 60)))) for i in range(n)]


EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "Ä"), (9004, "Ä"), (9005, "long " * 20000), (None, "no id"), (None, None)]


# ---------------------------------------------------------------- op5
def brute_fingerprint(text):
    w = token_bytes(text)
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(keys, linked):
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def test_simhash_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_POINTS", 16)  # several leaves, some of them in parts
    rows = texts(150)
    rows += [(1000 + i, t + " tail") for i, (_, t) in enumerate(rows[:60]) if len(t) > 100] + [(i + 2000, t) for i, t in rows[:20]] + EDGES
    got = simhash.near_duplicates(docs(spark, rows).repartition(3)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints, lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    smallest = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    want = Counter((i, p, smallest.get(r)) for (i, _), p, r in zip(rows, prints, roots))
    assert Counter((r["id"], r["fp"] % 2 ** 64, r["component_id"]) for r in got) == want
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "score", "component_id"] and kept.count() == len(set(roots))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_vantage_trees_meet_every_near_pair():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 2 ** 32, 3000, dtype=np.uint32)
    y = x ^ (np.uint32(1) << rnd.integers(0, 32, 3000).astype(np.uint32))
    tree = simhash.VantageTree(x[:800], 5, 1, 0)
    at, leaf, visitor = simhash.route(np.concatenate([x, y]), tree.depth, tree.reach, tree.vantage, tree.radius)
    home = {i: n for i, n, v in zip(at, leaf, visitor) if not v}
    places = {(i, n) for i, n in zip(at, leaf)}
    assert len(home) == 6000
    assert all((i + 3000, home[i]) in places or (i, home[i + 3000]) in places for i in range(3000))


# ---------------------------------------------------------------- op1
def test_lm_base_scores_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 20)  # most tokens go through the join
    rows = texts(120) + [(500 + i, f"rare{i} once") for i in range(20)] + EDGES
    keep = ~held_out(F.col("doc_id"), 7, 2)
    got = lm.score(docs(spark, rows).repartition(2), keep).collect()
    train, all_ = Counter(), []
    for i, t in rows:
        c = Counter(token_bytes(t)) + Counter([b""])
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        all_.append((i, held, c))
        if not held:
            train.update(c)
    n, v = sum(train.values()), len(train)
    want = sorted((-1 if i is None else i, h, sum(c.values()), sum(k for w, k in c.items() if train[w]), n,
                   sum(k * math.log10((train[w] + 1) / (n + v + 1)) for w, k in c.items())) for i, h, c in all_)
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score(docs(spark, []), keep).count() == 0
    untrained = lm.score(docs(spark, [(1, "a b"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in untrained] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


def test_lm_trained_model_adds_up_to_one(spark, monkeypatch):
    """After any context the words, the tokens of the rare classes and one unseen token of each are all there is."""
    monkeypatch.setattr(lm, "BATCH", 64)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices([f"{a}{b}" for a in "abcdefgh" for b in ("x", "yy", "zzz")], k=rnd.randrange(3, 30)))) for i in range(200)]
    training = docs(spark, rows).select("text")
    counts = lm.count_tokens(training)
    vocabulary = lm.Vocabulary(counts)
    assert vocabulary.side == 4 and vocabulary.words == 16 and vocabulary.classes == 4  # own words and rare ones
    shared = spark.sparkContext.broadcast(vocabulary.shared())
    p = lm.train(training, shared)
    assert not np.allclose(p[4], lm.start_parameters(vocabulary.shared())[4])
    known = [r["token"].decode() for r in counts.collect() if r["token"]]
    unseen = (vocabulary.rare_v * lm.DISCOUNT + 1) / (vocabulary.rare_n + 1)
    for before in ("", "ax byy", "nothing like czzz", "dx dx dx"):
        v = shared.value

        def log10(text):
            x = lm.Encoded(lm.pa.array([text]), v)
            return x, lm.token_log10(x, p, v["side"]) + np.where(x.number >= 0, v["inside"][np.maximum(x.number, 0)], 0.0)

        total = 10 ** log10(before)[1][-1]  # the end
        total += sum(10 ** log10(f"{before} {t}")[1][-2] for t in known)
        x, _ = log10(before)
        x.cls[-1] = 0
        for c in range(vocabulary.rare):  # an unseen token of each rare class
            x.cls[-1], x.word[-1] = vocabulary.classes + c, -1
            total += 10 ** lm.token_log10(x, p, v["side"])[-1] * unseen[c]
        assert total == pytest.approx(1.0, abs=1e-4)


def test_lm_context_tells_words_of_a_class_apart(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 64)
    rnd = random.Random(8)
    pairs = [("sun", "rises"), ("rain", "falls"), ("dog", "barks"), ("cat", "purrs"), ("bird", "sings"), ("fish", "swims")]
    rows = [(i, " ".join(" ".join(p) for p in rnd.choices(pairs, k=20))) for i in range(600)]
    out = lm.score(docs(spark, rows + [(10_001, "sun rises dog barks"), (10_002, "sun barks dog rises")]).coalesce(1), F.col("doc_id") < 10_000)
    got = {r["doc_id"]: r["score"] for r in out.where("doc_id > 10000").collect()}
    assert got[10_001] > got[10_002] + 1  # the same words, the same classes


def test_lm_tokens_are_those_of_the_rule():
    texts_ = ["A b\tC\x0bd\x0ce\r\nf", "", None, "  ", " É é\u00a0x ", "x" * 5]
    flat, n = lm.tokens_of(lm.pa.array(texts_))
    assert flat.to_pylist() == [t for x in texts_ for t in token_bytes(x)] and n.tolist() == [len(token_bytes(x)) for x in texts_]
    tokens = lm.pa.array([b"", b"a", b"ba", b"cba", b"xcba", b"cbb"])
    marks = lm.endings(tokens).tolist()
    assert marks[3] == marks[4] != marks[5] and marks[2:] == lm.endings(tokens[2:]).tolist()


# ---------------------------------------------------------------- op4, op10
def test_toxicity_finds_held_out_texts(spark):
    rows = texts(900, 3)
    toxic = {i for i, _ in rows if i % 6 == 0}
    rows = [(i, t + " Vile, slur!" if i in toxic else t) for i, t in rows] + EDGES
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(900)] + [(77777, 1), (None, 1)], "doc_id long, toxic int")
    out = held_out(F.col("doc_id"), 3, 1)
    weights, bias = toxicity.train(docs(spark, rows), labels, ~out)
    got = toxicity.score(docs(spark, rows), weights, bias)
    assert got.columns.count("score") == 1 and got.count() == len(rows)
    held = got.where(out).where("doc_id < 900").collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] in toxic) for r in held) and held
    assert toxicity.train(docs(spark, rows), labels.where("toxic = 0"), ~out)[0] == {}
    assert toxicity.score(docs(spark, []), weights, bias).count() == 0


def test_quality_orders_grades(spark):
    rows = texts(600, 4)
    grade = {i: i % 3 for i, _ in rows}
    rows = [(i, t if grade[i] == 2 else t.replace(" ", "## ") if grade[i] == 1 else t.upper() + " !!" * 9) for i, t in rows] + EDGES
    ratings = spark.createDataFrame([(i, g) for i, g in grade.items()] + [(3, None), (88888, 2)], "doc_id long, rating int")
    model = quality.train(docs(spark, rows), ratings, F.col("rating"), ~held_out(F.col("doc_id"), 5, 1))
    assert model.grades == [0.0, 1.0, 2.0] and model.thresholds[0] < model.thresholds[1]
    got = quality.grade(docs(spark, rows), model, 1.0).collect()
    assert len(got) == len(rows) and all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    right = [(r["tail"] >= 0.5) == (grade[r["doc_id"]] >= 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(right) >= 0.95 * len(right)
    one = quality.train(docs(spark, rows), ratings.where("rating = 2"), F.col("rating"))
    assert all(r["tail"] == 1.0 for r in quality.grade(docs(spark, EDGES), one, 1.0).collect())


# ---------------------------------------------------------------- op6
def test_embedding_links_equal_brute_force(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(120, 16))
    vectors = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(base)]
    vectors += [(200 + i, [float(x) for x in base[i % 10] + rnd.normal(size=16) * 0.05], int((i % 10) % 2)) for i in range(60)]
    vectors += [(300, vectors[0][1], 0), (300, vectors[0][1], 0), (301, None, 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0),
                (304, [1.0, None] + [0.0] * 14, 0), (305, vectors[0][1], None), (306, [], 0), (307, [1.0, 2.0], 0)]
    got = nndescent.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).collect()
    usable = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in vectors]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if u else None for (_, v, _), u in zip(vectors, usable)]

    def linked(i, j):
        return usable[i] and usable[j] and vectors[i][2] == vectors[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.93

    roots = brute_components(vectors, linked)
    first = {r: min(vectors[i][0] for i in range(len(vectors)) if roots[i] == r) for r in set(roots)}
    want = Counter((v[0], sum(linked(i, j) for j in range(len(vectors)) if j != i), first[roots[i]], v[0] == first[roots[i]]) for i, v in enumerate(vectors))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def assert_equals_brute_force(spark, vectors):
    """``vectors``: (vec_id, embedding, label) with distinct ids."""
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
           nndescent.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")).collect()}
    ids, labels, x = np.array([v[0] for v in vectors]), np.array([v[2] for v in vectors]), np.array([v[1] for v in vectors])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(len(ids), dtype=bool)
    first = ids.copy()
    while True:
        least = np.minimum(first, np.where(near, first[None, :], ids.max()).min(axis=1))
        if (least == first).all():
            break
        first = least
    assert got == {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), first)}


def rotated(rnd, v, cosine):
    """A vector at ``cosine`` from the unit vector v."""
    w = rnd.normal(size=len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine ** 2) * w / np.linalg.norm(w)


def unit(rnd, dim):
    v = rnd.normal(size=dim)
    return v / np.linalg.norm(v)


def test_links_between_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "LABEL_BLOCK", 32)  # several blocks
    monkeypatch.setattr(nndescent, "TILE", 16)
    rnd = np.random.default_rng(16)
    one = unit(rnd, 32)
    centres = [one, rotated(rnd, one, 0.95), unit(rnd, 32)]
    vectors = [(100 * c + i, [float(x) for x in rotated(rnd, v, 0.9997)], 0) for c, v in enumerate(centres) for i in range(20)]
    vectors += [(1000 + i, [float(x) for x in unit(rnd, 32)], i % 3) for i in range(60)]
    assert_equals_brute_force(spark, vectors)


def test_small_labels_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "LEAF", 64)
    rnd = np.random.default_rng(26)
    points = [(i, "small", [float(x) for x in unit(rnd, 32)], 1) for i in range(60)]
    points += [(1000 + i, "large", [float(x) for x in unit(rnd, 32)], 1) for i in range(600)]
    leaves = nndescent._leaves(spark.createDataFrame(points, "rid long, label string, v array<double>, size long"), 0)
    count = {r["label"]: r["n"] for r in leaves.groupBy("label").agg(F.count_distinct("tree", "leaf").alias("n")).collect()}
    assert count["small"] == 1 and count["large"] > 5 * nndescent.TREES


def test_pairs_in_small_labels_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "LEAF", 2)
    monkeypatch.setattr(nndescent, "TREES", 1)  # few trees over small leaves, as many trees over deep ones
    rnd = np.random.default_rng(26)
    firsts = [unit(rnd, 32) for _ in range(300)]
    vectors = [(2 * i + k, [float(x) for x in (v, rotated(rnd, v, 0.935))[k]], 1 + i % 10) for i, v in enumerate(firsts) for k in (0, 1)]
    vectors += [(5000 + i, [float(x) for x in unit(rnd, 32)], 0) for i in range(600)]
    assert_equals_brute_force(spark, vectors)


def test_pairs_beside_a_hot_group_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "LEAF", 2)
    rnd = np.random.default_rng(36)
    centre, vectors = unit(rnd, 32), []
    for i in range(150):
        v = unit(rnd, 32)
        vectors += [(2 * i, [float(x) for x in v], 0), (2 * i + 1, [float(x) for x in rotated(rnd, v, 0.935)], 0)]
    vectors += [(5000 + i, [float(x) for x in rotated(rnd, centre, 0.9997)], 0) for i in range(250)]
    assert_equals_brute_force(spark, vectors)


def test_near_copies_do_not_fill_one_task(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "LEAF", 32)
    rnd = np.random.default_rng(46)
    centre = unit(rnd, 32)
    points = [(i, "a", [float(x) for x in rotated(rnd, centre, 0.9999)], 1) for i in range(2000)]
    runs = nndescent._runs(spark.createDataFrame(points, "rid long, label string, v array<double>, size long"), 0)
    groups = [r["n"] for r in runs.groupBy("label", "tree", "leaf", "run").agg(F.count("*").alias("n")).collect()]
    assert sum(groups) == 2000 * nndescent.TREES and max(groups) <= 4 * 32


# ---------------------------------------------------------------- op9
@pytest.mark.parametrize("digests, hot", [(1 << 19, 1 << 12), (0, 2), (0, 1 << 12)])
def test_warc_round_trip(spark, tmp_path, monkeypatch, digests, hot):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", digests)
    monkeypatch.setattr(warc, "HOT_PAGES", hot)
    rows = [(5, "http://a/%20x y", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (9, None, None), (4, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n"),
            (None, "n", "<p>é</p>"), (5, "again", "<p>é</p>"), (8, "z", "x" * 300000)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.round_trip(pages).collect()
    body = lambda h: (h or "").encode()
    want = []
    for i, url, html in rows:
        first = min(k for k, _, h in rows if body(h) == body(html) and k is not None)
        again = i is not None and i > first
        want.append((i, url, len(body(html)), base64.b32encode(hashlib.sha1(body(html)).digest()).decode(), "revisit" if again else "response",
                     first if again else None, None if again else body(html)))
    have = [(*r[:-1], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert Counter(map(repr, have)) == Counter(map(repr, want))
    path = str(tmp_path / "gz")
    warc.register(spark)
    records = warc.page_records(pages).select("record_id", "record_type", "target_uri", "refers_to", F.lit(None).cast("string").alias("payload_digest"),
                                              "payload_bytes", "payload")
    records.write.format("warc").option("compression", "gzip").mode("append").save(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        revisits = warc.read_archives(spark, path).where("record_type = 'revisit'")
        assert revisits.count() == sum(w[4] == "revisit" for w in want)
        by_uri = warc.read_archives(spark, path).where("target_uri = 'http://a/%20x y'")
        assert by_uri.count() == 1 and "= http://a/" not in by_uri._jdf.queryExecution().executedPlan().toString()  # the reader decides
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_do_not_move(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert "Exchange hashpartitioning" not in warc.page_records(pages)._jdf.queryExecution().executedPlan().toString()


def test_warc_query_filters_by_pushdown(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "a"), (3, "w", "b")], "page_id long, url string, html string")
    asked, read = [], warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **b: asked.append(b) or read(*a, **b))
    want = [(1, "response"), (2, "revisit"), (3, "response")]
    for on in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        try:
            got = warc.round_trip(pages)
            assert sorted((r["page_id"], r["record_type"]) for r in got.collect()) == want
            plan = got._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        assert all(("record_type" in b) == (on == "false") for b in asked) and len(asked) == 2
        assert ("record_type" in plan and "= response" in plan) == (on == "false"), plan  # pushed: the reader decides
        asked.clear()
