"""Connected components of an edge table, as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.session import saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of ``edges``.

    Alternating large-star and small-star: every round links each node's
    neighbours to the smallest one around.  The rounds end when the edge table
    no longer changes; their number grows with the logarithm of the longest
    path.  Minima are pre-aggregated before the shuffle, and each round's
    table is written to the shared folder."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = saved(e)
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        e = saved(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return (e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
