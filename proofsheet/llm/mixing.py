"""Operator 8: mixing sources to target weights by hierarchical budgeting.

Weights run down a domain / language / source tree.  At each node the budget
is shared among the children by weight; a child that cannot fill its share is
filled up and the rest goes to its siblings; only what a whole subtree lacks
reaches the siblings of its ancestors (a node's capacity is that of its subtree's
leaves without a weight of zero on their path).
Each leaf then takes whole seeded epochs of its documents, and of the last
epoch the longest prefix, in the seeded order, that fits the remaining tokens.

Only DataFrame functions.  Documents themselves are not moved for their order: it
is decided within a leaf on (hash, tokens) digests summed in hash buckets, and
each leaf's answer is one cut-off hash, joined back on the leaf.  Leaves are
broadcast while their table is small in rows and bytes; more of them than that
are met by a shuffle of the documents, each leaf dealt to several tasks.

Defined results: null levels are a node of their own named ``(null)``; null or
empty texts have no tokens and belong to every epoch taken up to their place
in the order; rows that share an id are taken together; an empty table gives
an empty result; zero weight takes nothing; input columns named like outputs
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from proofsheet.llm.text import n_tokens
from proofsheet.session import saved

#: Documents that one bucket of a leaf's order holds on average.
BUCKET_ROWS = 2000
#: Rows and bytes of names up to which a table of leaves is broadcast; beyond either it meets the documents by a
#: shuffle in which each leaf is dealt to SALTS tasks.
BROADCAST_LEAVES, BROADCAST_NAMES, SALTS = 200_000, 32 << 20, 64


def weight_of(column: Column, weights: dict[str, float], default: float) -> Column:
    """Weight of a node by its name; ``weights`` is a small parameter."""
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(column == name, F.lit(float(w))).otherwise(out)
    return out


def fill_by_weight(df: DataFrame, parent: list[str], child: str, budget: str, weight: str, capacity: str, out: str) -> DataFrame:
    """Share ``budget`` among a parent's children by weight, none above its capacity.

    Children in the order of capacity / weight: the first child whose share of
    what is left fits fixes the rate for itself and all later ones; those
    before it are full.  One row per node, so a window holds one parent's children."""
    cap = F.when(F.col(weight) > 0, F.col(capacity).cast("double")).otherwise(0.0)
    df = df.withColumn("__cap", cap).withColumn(
        "__ratio", F.when(F.col(weight) > 0, F.col("__cap") / F.col(weight)).otherwise(0.0))
    w = W.partitionBy(*parent).orderBy("__ratio", child)
    df = (df.withColumn("__full", F.coalesce(F.sum("__cap").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
          .withColumn("__left", F.sum(weight).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
          .withColumn("__rate", F.when(F.col("__left") > 0, (F.col(budget) - F.col("__full")) / F.col("__left"))))
    fits = F.when(F.col("__rate") <= F.col("__ratio"), F.col("__rate"))
    df = df.withColumn("__rate", F.first(fits, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    share = F.when(F.col("__rate").isNull(), F.col("__cap")).otherwise(
        F.least(F.col("__cap"), F.greatest(F.lit(0.0), F.col("__rate")) * F.col(weight)))
    return df.withColumn(out, share).drop("__cap", "__ratio", "__full", "__left", "__rate")


def budgets(leaves: DataFrame, levels: list[str], weights: list[tuple[dict[str, float], float]],
            budget_share: float, max_epochs: int) -> DataFrame:
    """Token targets of the leaves.  ``leaves``: levels..., ``available`` tokens
    and ``n_docs``, one row per leaf (as many as there are sources)."""
    placed = F.lit(True)  # nothing is placed below a node of weight zero, so its subtree has no capacity
    for level, (named, default) in zip(levels, weights):
        placed = placed & (weight_of(F.col(level), named, default) > 0)
    node = leaves.withColumn("__cap0", F.when(placed, (F.col("available") * max_epochs).cast("double")).otherwise(0.0))
    total = leaves.agg(F.sum("available")).first()[0] or 0  # one number
    node = node.withColumn("__b0", F.floor(F.lit(total).cast("long") * F.lit(float(budget_share))).cast("double"))
    for i, level in enumerate(levels):
        path = levels[:i + 1]
        nodes = (node.groupBy(*path).agg(F.sum("__cap0").alias("__c"), F.max(f"__b{i}").alias(f"__b{i}"))
                 .withColumn("__w", weight_of(F.col(level), *weights[i])))
        parent = path[:-1] or [F.lit(0)]
        nodes = fill_by_weight(nodes, parent, level, f"__b{i}", "__w", "__c", f"__b{i + 1}")
        node = node.join(nodes.select(*path, f"__b{i + 1}"), path)
    return node.select(*levels, "available", "n_docs", F.floor(F.col(f"__b{len(levels)}") + 1e-6).cast("long").alias("target"))


def join_leaves(rows: DataFrame, leaves: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the columns of their leaf; a leaf of any share of the rows stays spread."""
    n, size = leaves.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat(*names)).cast("long")), F.lit(0))).first()
    if n <= BROADCAST_LEAVES and size <= BROADCAST_NAMES:
        return rows.join(F.broadcast(leaves), names)
    dealt = leaves.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(dealt, [*names, "__salt"]).drop("__salt")


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[tuple[dict[str, float], float]], budget_share: float,
        max_epochs: int = 1, seed: int = 17, key: str = "doc_id", text: str = "text",
        tokens: str = "n_tokens", epoch: str = "epoch") -> DataFrame:
    """``docs`` with the levels, ``tokens`` and ``epoch``: one row for each
    time that a document is taken.  ``levels`` names the tree's levels from
    the top down; every column of the input stays."""
    names = list(levels)
    if max_epochs < 1:
        raise ValueError("max_epochs must be 1 or more")
    inner = [f"__l{i}" for i in range(len(names))]
    rows = docs.withColumns({i: F.coalesce(c.cast("string"), F.lit("(null)")) for i, c in zip(inner, levels.values())}
                            | {"__tokens": n_tokens(F.col(text)), "__id": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    light = saved(rows.select(*inner, "__id", "__tokens"))  # ids and counts only: the texts are read again, not moved
    leaves = saved(light.groupBy(*inner).agg(F.sum("__tokens").alias("available"), F.count("*").alias("n_docs")))
    leaves = budgets(leaves, inner, weights, budget_share, max_epochs)
    can = F.col("available") > 0
    leaves = saved(
        leaves.withColumn("__full", F.when(can, F.floor(F.col("target") / F.col("available"))).otherwise(0).cast("int"))
        .withColumn("__rest", F.when(can, F.col("target") - F.col("__full") * F.col("available")).otherwise(0).cast("long"))
        .withColumn("__digits", F.least(F.lit(32), F.ceil(F.log(F.greatest(F.col("n_docs") / BUCKET_ROWS, F.lit(1.0))) / F.log(F.lit(16.0)))
                                        ).cast("int")))

    def order(full: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}:"), full.cast("string"), F.lit(":"), F.col("__id")).cast("binary"))

    # the longest prefix of each leaf, first by buckets of the order, then within the bucket where it ends
    ordered = (join_leaves(light, leaves.where("__rest > 0").select(*inner, "__full", "__rest", "__digits"), inner)
               .withColumn("__h", order(F.col("__full")))
               .withColumn("__bucket", F.expr("substring(__h, 1, __digits)")))
    by_bucket = W.partitionBy(*inner).orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    buckets = (ordered.groupBy(*inner, "__bucket", "__rest").agg(F.sum("__tokens").alias("__sum"), F.max("__h").alias("__last"))
               .withColumn("__upto", F.sum("__sum").over(by_bucket)))
    whole = buckets.where("__upto <= __rest").groupBy(*inner).agg(F.max("__last").alias("__cut"))
    ends = (buckets.where("__upto > __rest").groupBy(*inner)
            .agg(F.min_by("__bucket", "__bucket").alias("__bucket"),
                 F.min_by(F.col("__upto") - F.col("__sum"), "__bucket").alias("__before")))
    by_hash = W.partitionBy(*inner, "__bucket").orderBy("__h").rowsBetween(W.unboundedPreceding, W.currentRow)
    part = (ordered.join(ends, [*inner, "__bucket"])
            .groupBy(*inner, "__bucket", "__before", "__rest", "__h").agg(F.sum("__tokens").alias("__sum"))
            .withColumn("__upto", F.col("__before") + F.sum("__sum").over(by_hash))
            .where("__upto <= __rest").groupBy(*inner).agg(F.max("__h").alias("__cut")))
    cuts = whole.unionByName(part).groupBy(*inner).agg(F.max("__cut").alias("__cut"))
    plan = saved(leaves.join(cuts, inner, "left").select(*inner, "__full", "__cut"))

    taken = F.when(F.coalesce(order(F.col("__full")) <= F.col("__cut"), F.lit(False)), F.col("__full") + 1).otherwise(F.col("__full"))
    out = (join_leaves(rows, plan, inner).withColumn("__times", taken).where("__times > 0")
           .withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col("__times") - 1))))
    return (out.withColumns({n: F.col(i) for n, i in zip(names, inner)} | {tokens: F.col("__tokens")})
            .drop(*inner, "__tokens", "__id", "__full", "__cut", "__times"))
