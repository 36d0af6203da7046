"""Operator 5: near-duplicates by SimHash fingerprints in vantage-point trees.

Fingerprints are the bit majorities of the XXH64 values of a text's word
shingles.  Equal fingerprints meet by a pre-aggregated grouping.  Distinct
ones within ``max_bits`` differ in one of their two halves by at most
``max_bits // 2`` bits, so there is one vantage-point tree for each half: a
node sends a point left if its Hamming distance to the node's vantage point is
at most the node's radius.  By the triangle bound, a pair that the node parts
has its left point within ``reach`` of the border; such points also visit the
right side, and go on there into every branch that their ball touches.  Each
leaf is a shard: all its points, and its visitors, are compared on the whole
fingerprint, exactly.  A leaf hands on one star per linked set, never all pairs.

The trees' vantage points come from a bounded sample (VANTAGE_SAMPLE); they
only decide where points meet, all fingerprints are routed and compared.  A
leaf that grows beyond LEAF_POINTS is compared in several tasks, each with a
part of its queries.

Defined results: null and empty texts have fingerprint 0 and are linked like
others; repeated rows are in one group; ids may be null (the group's id is its
smallest non-null id, null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.llm.graph import connected_components
from proofsheet.llm.text import row_key, slices, text_hash, token_bytes
from proofsheet.session import saved

#: Distinct fingerprints that may become vantage points (bounded, on the driver).
VANTAGE_SAMPLE = 40_000
#: Points a leaf aims at; also the most that one task takes from a larger leaf.
LEAF_POINTS = 2_500
#: Pairs compared at once.
BLOCK_PAIRS = 1 << 21


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = token_bytes(text)
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, fp) of every document; fp as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["id", "text_hash", "fp"])

    src = docs.select(F.col(doc_id).cast("long").alias("id"), text_hash(F.col(text)).alias("text_hash"),
                      F.col(text).alias("text"))
    return src.mapInArrow(run, "id long, text_hash long, fp long")


class VantageTree:
    """A tree over one half of the fingerprint, in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, reach: int, seed: int):
        self.depth, self.reach = depth, reach
        self.vantage = np.zeros(1 << depth, dtype=np.uint32)
        self.radius = np.full(1 << depth, 64, dtype=np.int16)  # 64: everything stays left
        rnd = np.random.default_rng(seed)
        inside = {1: np.unique(sample)}
        for node in range(1, 1 << depth):
            points = inside.pop(node, np.empty(0, np.uint32))
            if len(points) >= 2:
                best = None
                for v in rnd.choice(points, size=min(6, len(points)), replace=False):
                    d = np.bitwise_count(points ^ v).astype(np.int16)
                    counts = np.bincount(d, minlength=33)
                    left = np.cumsum(counts)
                    border = left - np.concatenate([np.zeros(reach, int), left])[:len(left)]  # points that also visit the right
                    cost = left.astype(float) ** 2 + (len(points) - left) * (len(points) - left + border).astype(float)
                    mu = int(np.argmin(np.where((left > 0) & (left < len(points)), cost, np.inf)))
                    if 0 < left[mu] < len(points) and (best is None or cost[mu] < best[0]):
                        best = (cost[mu], v, mu, d)
                if best:
                    _, self.vantage[node], self.radius[node], d = best
                    if 2 * node < 1 << depth:
                        inside[2 * node], inside[2 * node + 1] = points[d <= self.radius[node]], points[d > self.radius[node]]
                    continue
            if 2 * node < 1 << depth:
                inside[2 * node] = points


def route(x: np.ndarray, depth: int, reach: int, vantage: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, visitor) of each place a point belongs to or visits."""
    at, node, visits = np.arange(len(x)), np.ones(len(x), np.int64), np.zeros(len(x), bool)
    for _ in range(depth):
        d = np.bitwise_count(x[at] ^ vantage[node]).astype(np.int16)
        mu = radius[node]
        left = np.where(visits, d - reach, d) <= mu
        right = d + reach > mu  # a point whose home is on the left is a visitor there
        away = visits | (d <= mu)
        at, node, visits = (np.concatenate([at[left], at[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1]),
                            np.concatenate([visits[left], away[right]]))
    return at, node, visits


def _halves(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u >> np.uint64(32)).astype(np.uint32), (u & np.uint64(0xFFFFFFFF)).astype(np.uint32)]


def _leaf_stars(pdf: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """One (point, root) row for each point that is not its set's root."""
    points, index = np.unique(pdf["fp"].to_numpy(np.int64), return_inverse=True)
    u = points.view(np.uint64)
    members = np.unique(index[~pdf["visitor"].to_numpy(bool)])
    queries = np.unique(index[pdf["query"].to_numpy(bool)])
    label = np.arange(len(points))
    step = max(1, BLOCK_PAIRS // max(1, len(members)))
    for at in range(0, len(queries), step):
        q = queries[at:at + step]
        near = np.bitwise_count(u[q][:, None] ^ u[members][None, :]) <= max_bits
        qi, mi = np.nonzero(near)
        x, y = q[qi], members[mi]
        while True:
            lx, ly = label[x], label[y]
            apart = lx != ly
            if not apart.any():
                break
            x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
            root = np.arange(len(points))
            np.minimum.at(root, np.maximum(lx, ly), np.minimum(lx, ly))
            while not np.array_equal(root, up := root[root]):
                root = up
            label = root[label]
    moved = np.flatnonzero(label != np.arange(len(points)))
    return pd.DataFrame({"a": points[moved], "b": points[label[moved]]})


def near_links(points: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within
    ``max_bits`` of one another: stars of each leaf's linked sets."""
    spark = points.sparkSession
    n = points.count()
    reach = max_bits // 2
    sample = np.array([r[0] for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(VANTAGE_SAMPLE).collect()], dtype=np.int64)
    depth = int(np.clip(np.ceil(np.log2(max(n, 1) / LEAF_POINTS)), 0, np.log2(VANTAGE_SAMPLE / 16)))
    grown = [VantageTree(h, depth, reach, seed) for seed, h in enumerate(_halves(sample))]
    trees = spark.sparkContext.broadcast([(depth, reach, t.vantage, t.radius) for t in grown])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for tree, half in enumerate(_halves(fp)):
                at, leaf, visitor = route(half, *trees.value[tree])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(leaf), pa.array(fp[at]), pa.array(visitor)],
                                                 ["tree", "leaf", "fp", "visitor"])

    routed = saved(points.select("fp").mapInArrow(send, "tree int, leaf long, fp long, visitor boolean"))
    # at most two trees' leaves: bounded by the sample
    parts = F.greatest(F.lit(1), F.ceil(F.count("*") / (4 * LEAF_POINTS))).cast("int")
    sizes = routed.groupBy("tree", "leaf").agg(parts.alias("parts"))
    turn = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    placed = (routed.join(F.broadcast(sizes), ["tree", "leaf"])
              .withColumn("part", F.explode(F.when(F.col("visitor"), F.array(turn)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
              .withColumn("query", F.col("part") == turn).select("tree", "leaf", "part", "fp", "visitor", "query"))
    return placed.groupBy("tree", "leaf", "part").applyInPandas(lambda pdf: _leaf_stars(pdf, max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, fp, component, component_id): the group of every
    document; ``component`` names the group also where ids are null."""
    prints = saved(fingerprints(docs, shingle, doc_id, text))
    points = saved(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    groups = connected_components(near_links(points, max_bits))
    named = (points.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("component", F.coalesce("component", "fp")))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = saved(named.select("fp", "component").join(ids, "component"))
    return prints.join(named, "fp")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id's."""
    groups = near_duplicates(docs, shingle, max_bits, doc_id, text)
    best = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    keep = groups.groupBy("component").agg(F.min(best).alias("k"), F.count("*").alias("n"))
    keep = saved(keep.select(row_key(F.col("k.id"), F.col("k.text_hash")).alias("__key")))
    marked = docs.withColumn("__key", row_key(F.col(doc_id).cast("long"), text_hash(F.col(text))))
    out = marked.join(keep, "__key", "left_semi")
    # repeated rows (same id and text) share a key: only then is there more than one row to choose from
    again = marked.groupBy("__key").count().where("count > 1").limit(1).count()
    return (out.dropDuplicates(["__key"]) if again else out).drop("__key")
