"""Operator 6: embedding near-duplicates by NN-descent.

Vectors are compared within a label only; equal vectors are one point with a
count.  All lists hold angles.

Classes: points that meet in a leaf of random hyperplanes and lie within half
the threshold's angle of a representative make a class; any two of them are
linked, whatever their number, so dense sets need no lists of their own.  Some
rounds over new hyperplanes collapse representatives further.

NN-descent over the classes: each starts with neighbours from the leaves; then
every class introduces its neighbours, and those it is a neighbour of, to one
another, as long as its list has news.  Lists are ordered by gap, the angle of
the representatives less both radii; only classes with a gap up to the
threshold's angle can have linked members.  A list whose last entry is still
that near is saturated: it is enlarged to twice its length, and leaves and
descent run again, until no list is saturated and no link is new.

Threshold edges: of the listed pairs of classes those whose members are all
linked by the triangle bound count by class size; the members of the others are
compared in double precision, by pairs of blocks.

Audit: AUDIT points (all, if fewer) are compared with all points of their
label; while the mean share of their links that was found is below RECALL, all
lists double and new hyperplanes are drawn.

Defined results: vectors with a null label, that are null, empty, zero or hold
null or non-finite components link with nothing; vectors of unequal lengths are
not compared; repeated rows are links of one another; rows with a null id link
with nothing and have no component; an empty table gives no rows; outputs
replace input columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from proofsheet.llm.graph import connected_components
from proofsheet.session import saved

NEIGHBOURS, TREES, LEAF, SEED = 8, 5, 128, 0
#: Points of one block, and of one matrix product, when the members of two classes are compared.
LABEL_BLOCK, TILE = 16384, 2048
#: Classes that introduce their neighbours in one task group, on average.
HOSTS = 4096
#: Radians by which bounds are kept away from what floating point could turn.
SLACK = 1e-5
#: Points of the audit, which the driver holds, and the mean share of their links that must be found.
AUDIT, RECALL = 2048, 0.999


def _matrix(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distinct_points(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(rid, label, v, size): usable vectors, equal ones once, named by the smallest id."""
    e = F.col("e")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    fine = F.size(e) > 0
    fine = fine & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select("id", F.concat_ws("/", "label", F.size("e")).alias("label"), F.transform("e", lambda x: x + 0.0).alias("v")).groupBy("label", "v").agg(
        F.min("id").alias("rid"), F.count("*").alias("size")).select("rid", "label", "v", "size")


def _depth(points: DataFrame) -> DataFrame:
    """``points`` with the number of points in their label, and the hyperplanes that cut such a label into leaves."""
    counts = points.groupBy("label").agg(F.count("*").alias("in_label"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("in_label") / LEAF))).cast("int")
    return points.join(counts.withColumn("depth", depth), "label")


def _leaves(points: DataFrame, seed: int, trees: int | None = None) -> DataFrame:
    """(rid, label, v, tree, leaf): sides of random hyperplanes.

    Each label has as many hyperplanes as its own count asks for; one that fits a leaf is one leaf, of one tree."""
    trees = trees or TREES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column(2).to_pylist()]
            kinds = list(zip(batch.column(3).to_pylist(), map(len, vectors)))
            for depth, dim in set(kinds):
                which = [i for i, kind in enumerate(kinds) if kind == (depth, dim)]
                if (depth, dim) not in planes:
                    planes[depth, dim] = np.random.default_rng([seed, depth, dim]).normal(size=(dim, trees * depth))
                side = _matrix([vectors[i] for i in which]) @ planes[depth, dim]
                rows = batch.take(pa.array(which))
                for t in range(trees if depth else 1):
                    leaf = ((side[:, t * depth:(t + 1) * depth] > 0) @ (1 << np.arange(depth))).astype(np.int64) if depth else np.zeros(len(which), np.int64)
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(np.full(len(which), t, np.int32)),
                                                      pa.array(leaf)], ["rid", "label", "v", "tree", "leaf"])

    return (_depth(points).select("rid", "label", "v", "depth")
            .mapInArrow(run, "rid long, label string, v array<double>, tree int, leaf long"))


def _runs(points: DataFrame, seed: int, trees: int | None = None) -> DataFrame:
    """The leaves' rows with ``run``: leaves of more than 2 * LEAF points are
    dealt out in Spark, anew for each tree, so that no group grows with a set of near copies."""
    leaves, leaf = _leaves(points, seed, trees), ["label", "tree", "leaf"]
    crowded = saved(leaves.groupBy(*leaf).agg(F.ceil(F.count("*") / (2 * LEAF)).alias("runs")).where("runs > 1"))
    run = F.pmod(F.xxhash64("rid", "tree", F.lit(seed)), F.col("runs"))
    return leaves.join(crowded, leaf, "left").withColumn("run", F.coalesce(run, F.lit(0))).drop("runs")


def angles(s: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(s, -1, 1))


# ---------------------------------------------------------------- classes
def collapse(points: DataFrame, theta: float, seed: int) -> DataFrame:
    """(rid, rep): the representative of every point, within half of ``theta``."""
    half = theta / 2 - SLACK
    now, chain = points.select("rid", "label", "v", F.lit(0.0).alias("r")), None

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        ids, r = pdf["rid"].to_numpy(), pdf["r"].to_numpy().copy()
        x = _matrix(pdf["v"])
        far, rep = angles(x @ x.T), np.full(len(ids), -1)
        for i in range(len(ids)):
            if rep[i] < 0:
                mine = (rep < 0) & (far[i] + r <= half)
                mine[i] = True
                others = mine.copy()
                others[i] = False
                rep[mine] = i
                r[i] = max(r[i], (far[i] + r)[others].max(initial=0))
        return pd.DataFrame({"rid": ids, "rep": ids[rep], "r": r})

    n = points.count()
    for t in range(TREES):
        radii = now.select("rid", "r")
        groups = _runs(now, seed + 100 + t, 1).join(radii, "rid").groupBy("label", "tree", "leaf", "run")
        step = saved(groups.applyInPandas(gather, "rid long, rep long, r double"))
        chain = step.select("rid", "rep") if chain is None else chain.join(
            step.select(F.col("rid").alias("rep"), F.col("rep").alias("next")), "rep").select("rid", F.col("next").alias("rep"))
        chain = saved(chain)
        before, n = n, step.where("rid = rep").count()
        now = saved(now.select("rid", "label", "v").join(step.where("rid = rep").select("rid", "r"), "rid"))
        if n > 0.98 * before:
            break
    return chain


def classes_of(points: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (rid, label, v, size, cid) and classes (rid, label, v, r, weight, points): ``rid`` of a class,
    the ``cid`` of its members, is the smallest of theirs, ``v`` its representative's vector."""
    rows = points.join(reps, "rid").join(points.select(F.col("rid").alias("rep"), F.col("v").alias("centre")), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [float(angles((_matrix([a])[0] * _matrix([b])[0]).sum())) if i != j else 0.0 for i, j, a, b in
                   zip(*(batch.column(c).to_pylist() for c in range(4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64()), batch.column(4)], ["rid", "rep", "far", "size"])

    far = saved(rows.select("rid", "rep", "v", "centre", "size").mapInArrow(run, "rid long, rep long, far double, size long"))
    named = far.groupBy("rep").agg(F.min("rid").alias("cid"), F.max("far").alias("r"), F.sum("size").alias("weight"), F.count("*").alias("points"))
    classes = saved(named.join(points.select(F.col("rid").alias("rep"), "label", "v"), "rep").select(
        F.col("cid").alias("rid"), "label", "v", F.when(F.col("r") > 0, F.col("r") + SLACK / 10).otherwise(0.0).alias("r"), "weight", "points", "rep"))
    members = saved(points.join(reps, "rid").join(classes.select("rep", F.col("rid").alias("cid")), "rep").drop("rep"))
    return members, classes.drop("rep")


# ---------------------------------------------------------------- lists
PAIRS = "a long, b long, g double"


def _start(classes: DataFrame, ks: DataFrame, seed: int) -> DataFrame:
    """The nearest others that each class meets in leaves, as many as its list takes."""
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, r, k = pdf["rid"].to_numpy(), pdf["r"].to_numpy(), pdf["k"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "g": np.empty(0)})
        x = _matrix(pdf["v"])
        g = angles(x @ x.T) - r[:, None] - r[None, :]
        np.fill_diagonal(g, np.inf)
        most = int(min(k.max(), len(ids) - 1))
        best = np.argsort(g, axis=1)[:, :most]
        a, place = np.divmod(np.arange(best.size), most)
        take = place < k[a]
        a, b = a[take], best.ravel()[take]
        return pd.DataFrame({"a": ids[a], "b": ids[b], "g": g[a, b]})

    rows = _runs(classes, seed).join(classes.select("rid", "r"), "rid").join(ks, "rid")
    return rows.groupBy("label", "tree", "leaf", "run").applyInPandas(meet, PAIRS)


def _best(pairs: DataFrame, ks: DataFrame) -> DataFrame:
    """The best entries of each list, as many as it takes."""
    w = W.partitionBy("a").orderBy("g", "b")
    ranked = pairs.groupBy("a", "b").agg(F.min("g").alias("g")).withColumn("place", F.row_number().over(w))
    return ranked.join(ks.withColumnRenamed("rid", "a"), "a").where("place <= k").drop("place", "k")


def _descend(lists: DataFrame, news: DataFrame, classes: DataFrame, ks: DataFrame, blocks: int) -> DataFrame:
    """Every class with news introduces the classes on its list, and those on whose list it is (as many), to one another."""
    back = _best(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "g"), ks)
    worst = lists.groupBy("a").agg(F.max("g").alias("worst"), F.count("*").alias("n")).withColumnRenamed("a", "rid")
    full = ks.join(worst, "rid", "left").select("rid", F.when(F.col("n") >= F.col("k"), F.col("worst")).otherwise(float("inf")).alias("worst"))
    active = news.select(F.explode(F.array("a", "b")).alias("host")).distinct()
    host = lists.unionByName(back).select(F.col("a").alias("host"), F.col("b").alias("rid")).distinct().join(active, "host")
    guests = host.join(classes.select("rid", F.col("v").cast("array<float>").alias("v"), "r").join(full, "rid"), "rid")

    def introduce(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["host", "rid"])
        ids, worst_, r, x = pdf["rid"].to_numpy(), pdf["worst"].to_numpy(), pdf["r"].to_numpy(), None
        dims = pdf["v"].map(len).to_numpy()
        _, first, n = np.unique(pdf["host"].to_numpy(), return_index=True, return_counts=True)
        for dim in np.unique(dims):
            x = np.zeros((len(ids), dim))
            x[dims == dim] = _matrix(pdf["v"][dims == dim])
            for size in np.unique(n[dims[first] == dim]):
                at = first[(n == size) & (dims[first] == dim)][:, None] + np.arange(size)
                step = max(1, (1 << 20) // int(size * size))
                for i in range(0, len(at), step):
                    part = at[i:i + step]
                    g = angles(x[part] @ x[part].transpose(0, 2, 1)) - r[part][:, :, None] - r[part][:, None, :]
                    h, p, q = np.nonzero((g < worst_[part][:, :, None]) & ~np.eye(size, dtype=bool))
                    out.append(pd.DataFrame({"a": ids[part[h, p]], "b": ids[part[h, q]], "g": g[h, p, q]}))
        return pd.concat(out).drop_duplicates(["a", "b"]) if out else pd.DataFrame({"a": [], "b": [], "g": []})

    block = F.pmod(F.xxhash64("host"), F.lit(blocks)).cast("int")
    return guests.withColumn("block", block).groupBy("block").applyInPandas(introduce, PAIRS)


def neighbours(classes: DataFrame, lists: DataFrame | None, ks: DataFrame, theta: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Lists that the descent no longer improves and that end beyond ``theta``, and their lengths."""
    blocks = max(classes.sparkSession.sparkContext.defaultParallelism * 4, -(-classes.count() // HOSTS))
    while True:
        start = _start(classes, ks, seed)
        news = lists = saved(_best(start if lists is None else start.unionByName(lists), ks))
        links = None
        while True:
            better = _best(lists.unionByName(_descend(lists, news, classes, ks, blocks)), ks)
            lists = saved(better.join(lists.select("a", "b", F.lit(False).alias("new")), ["a", "b"], "left").withColumn("new", F.coalesce("new", F.lit(True))))
            n_news, n, near = lists.agg(F.count_if("new"), F.count("*"), F.count_if(F.col("g") <= theta)).first()
            news, lists = lists.where("new"), lists.drop("new")
            if n_news <= 0.01 * n and near == links:
                break
            links = near
        ends = lists.groupBy("a").agg(F.count("*").alias("n"), F.max("g").alias("g")).withColumnRenamed("a", "rid")
        grown = saved(ks.join(ends, "rid", "left").select("rid", "k", F.coalesce((F.col("n") >= F.col("k")) & (F.col("g") <= theta + SLACK), F.lit(False)).alias("full")))
        if not grown.where("full").limit(1).count():
            return lists, ks
        ks = grown.select("rid", F.when(F.col("full"), F.col("k") * 2).otherwise(F.col("k")).alias("k"))


# ---------------------------------------------------------------- links
def _member_pairs(pairs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of both classes of each pair, once for each pair of their blocks; small pairs share groups."""
    blocks = classes.select("rid", F.ceil(F.col("points") / LABEL_BLOCK).cast("int").alias("blocks"))
    pairs = pairs.join(blocks.withColumnsRenamed({"rid": "a", "blocks": "na"}), "a").join(blocks.withColumnsRenamed({"rid": "b", "blocks": "nb"}), "b")
    sides = pairs.select("a", "b", "na", "nb", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("cid")),
                                                                  F.struct(F.lit(1).alias("side"), F.col("b").alias("cid")))).alias("s")).select("a", "b", "na", "nb", "s.*")
    rows = sides.join(members, "cid")
    own, others = F.when(F.col("side") == 0, F.col("na")).otherwise(F.col("nb")), F.when(F.col("side") == 0, F.col("nb")).otherwise(F.col("na"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rid"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    shared = max(members.sparkSession.sparkContext.defaultParallelism * 4, -(-members.count() // LABEL_BLOCK))
    small = (F.col("na") == 1) & (F.col("nb") == 1)
    name = F.when(small, F.pmod(F.xxhash64("a", "b"), F.lit(shared)).cast("string")).otherwise(F.concat_ws("/", "a", "b"))
    first, second = F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine"))
    return rows.select("a", "b", "side", "rid", "v", "size", name.alias("group"), first.alias("i"), second.alias("j"))


def class_links(lists: DataFrame, members: DataFrame, classes: DataFrame, theta: float, threshold: float) -> DataFrame:
    """(kind, a, b, n): 'class': n links of every member of class a; 'member': n links of point a; 'edge': classes a and b are linked."""
    near = lists.where(F.col("g") <= theta + SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "g").groupBy("a", "b").agg(F.min("g").alias("g"))
    side = classes.select("rid", "r", "weight")
    near = near.join(side.withColumnsRenamed({"rid": "a", "r": "ra", "weight": "wa"}), "a").join(side.withColumnsRenamed({"rid": "b", "r": "rb", "weight": "wb"}), "b")
    near = saved(near.withColumn("all", F.col("g") + 2 * (F.col("ra") + F.col("rb")) <= theta - SLACK))
    whole = near.where("all")
    whole = whole.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("a"), y.alias("b"), n.cast("long").alias("n")) for k, x, y, n in (
        ("class", F.col("a"), F.lit(None).cast("long"), F.col("wb")), ("class", F.col("b"), F.lit(None).cast("long"), F.col("wa")),
        ("edge", F.col("a"), F.col("b"), F.lit(0)))])).alias("x")).select("x.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: dict[int, int] = {}
        edges = []
        pdf = pdf.sort_values(["a", "b", "side"])
        pair = pdf[["a", "b"]].to_numpy()
        cuts = np.flatnonzero((pair[1:] != pair[:-1]).any(axis=1)) + 1
        ids, size, side_ = pdf["rid"].to_numpy(), pdf["size"].to_numpy(), pdf["side"].to_numpy()
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)]):
            x, cut = _matrix(pdf["v"].iloc[start:end]), start + int((side_[start:end] == 0).sum())
            linked = False
            for p in range(start, cut, TILE):
                for q in range(cut, end, TILE):
                    l, r = slice(p, min(p + TILE, cut)), slice(q, min(q + TILE, end))
                    hit = x[l.start - start:l.stop - start] @ x[r.start - start:r.stop - start].T >= threshold
                    if hit.any():
                        linked = True
                        for where, n in ((l, hit @ size[r]), (r, size[l] @ hit)):
                            for i, m in zip(ids[where].tolist(), n.tolist()):
                                if m:
                                    counts[i] = counts.get(i, 0) + m
            if linked:
                edges.append(tuple(pair[start].tolist()))
        rows = [("member", i, None, n) for i, n in counts.items()] + [("edge", i, j, 0) for i, j in edges]
        return pd.DataFrame({"kind": [r[0] for r in rows], "a": pd.array([r[1] for r in rows], "Int64"),
                             "b": pd.array([r[2] for r in rows], "Int64"), "n": pd.array([r[3] for r in rows], "Int64")})

    some = _member_pairs(near.where(~F.col("all")).select("a", "b"), members, classes)
    return whole.unionByName(some.groupBy("group", "i", "j").applyInPandas(compare, "kind string, a long, b long, n long"))


def counted(members: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Members with ``n``, the rows linked with each of their rows."""
    by_class = found.where("kind = 'class'").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("of_class"))
    by_member = found.where("kind = 'member'").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("of_member"))
    rows = members.join(classes.select(F.col("rid").alias("cid"), "weight"), "cid").join(by_class, "cid", "left").join(by_member, "rid", "left")
    zero = F.lit(0)
    return rows.withColumn("n", F.col("weight") - 1 + F.coalesce("of_class", zero) + F.coalesce("of_member", zero)).drop("weight", "of_class", "of_member")


def recall(points: DataFrame, links: DataFrame, threshold: float) -> float:
    """The mean share of their links that ``links`` (rid, n) has of AUDIT points; 1 if none of them has a link."""
    asked = points.orderBy(F.xxhash64("rid", F.lit(7)), "rid").limit(AUDIT).select("rid", "label", "v", "size").collect()
    by_label: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name in {r["label"] for r in asked}:
        mine = [r for r in asked if r["label"] == name]
        by_label[name] = np.array([r["rid"] for r in mine]), _matrix([r["v"] for r in mine])
    shared = points.sparkSession.sparkContext.broadcast(by_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            size = batch.column(2).to_numpy()
            for name in set(labels.tolist()) & set(shared.value):
                at = np.flatnonzero(labels == name)
                ids, x = shared.value[name]
                n = ((_matrix(batch.column(1).take(pa.array(at)).to_pylist()) @ x.T >= threshold) * size[at, None]).sum(axis=0)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some])], ["rid", "actual"])

    linked = points.select("label", "v", "size").mapInArrow(run, "rid long, actual long").groupBy("rid").agg((F.sum("actual") - 1).alias("actual")).where("actual > 0")
    share = linked.join(links.select("rid", "n"), "rid").agg(F.avg(F.least(F.col("n") / F.col("actual"), F.lit(1.0)))).first()[0]
    return 1.0 if share is None else share


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    theta = float(np.arccos(threshold))
    points = saved(distinct_points(vectors, vec_id, embedding, label))
    members, classes = classes_of(points, collapse(points, theta, SEED))
    lists, ks, seed = None, classes.select("rid", F.lit(NEIGHBOURS).alias("k")), SEED
    while True:
        lists, ks = neighbours(classes, lists, ks, theta, seed)
        found = saved(class_links(lists, members, classes, theta, threshold))
        links = saved(counted(members, classes, found))
        if recall(points, links, threshold) >= RECALL:
            break
        ks, seed = saved(ks.select("rid", (F.col("k") * 2).alias("k"))), seed + 1
    whole = saved(connected_components(found.where("kind = 'edge'").select("a", "b"))).select(F.col("node").alias("cid"), F.col("component").alias("whole"))
    links = saved(links.join(whole, "cid", "left").select("label", "v", F.coalesce("whole", "cid").alias("component"), "n"))
    e = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id), F.concat_ws("/", F.col(label).cast("string"), F.size(e)).alias("__label"),
                          F.when(F.col(vec_id).isNotNull() & F.col(label).isNotNull(), F.transform(e, lambda x: x + 0.0)).alias("__v"))
    out = rows.join(links, (F.col("__label") == F.col("label")) & (F.col("__v") == F.col("v")), "left")
    component = F.coalesce("component", F.col(vec_id).cast("long"))
    return out.select(vec_id, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col(vec_id) == component, F.lit(True)).alias("kept"))
