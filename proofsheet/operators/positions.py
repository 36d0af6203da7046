"""Positional building blocks that stay distributed.

* ``with_row_index`` (W1): stable row numbers without a global window —
  per-partition counts (one row per input partition) are prefix-summed and
  broadcast back.
* ``dense_position``: 0-based dense rank of rows by a *unique* ordering key,
  from range partitions sorted by it and the prefix sum of their counts.
* ``exact_quantiles``: linear-interpolated quantiles (the interpolation of
  pandas and DuckDB ``quantile_cont``) by range partitioning the values and
  locating the rank(s) with per-partition offsets.  Spark's ``percentile``
  keeps every distinct value of a group in one task; this does not.
* ``join_small``: broadcast a side only after its row count is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions.expr import col

BROADCAST_ROW_LIMIT = 2_000_000
PERCENTILE_MAP_LIMIT = 2_000_000  # values one task may hold for an exact percentile
_SEQ_BITS = 33  # monotonically_increasing_id = partition id << 33 | position


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_ROW_LIMIT, known_rows: int | None = None) -> DataFrame:
    """Join with ``small`` broadcast only when its row count is proven to be
    under ``max_rows``; otherwise a shuffle join (AQE splits skewed keys)."""
    rows = known_rows if known_rows is not None else small.count()
    if rows <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def stable_scan(df: DataFrame) -> bool:
    """True when ``df`` is a deterministic, exchange-free scan: its splits
    and the row order inside each split are re-planned identically on every
    execution (and on task retry), so partition ids and positions are stable."""
    qe = df._jdf.queryExecution()
    return bool(qe.optimizedPlan().deterministic()) and "Exchange" not in qe.executedPlan().toString()


def _tag(df: DataFrame, checkpoint: bool | None) -> DataFrame:
    from proofsheet.session import cut_lineage
    tagged = (df.withColumn("__pid", F.spark_partition_id())
                .withColumn("__seq", F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("long"), _SEQ_BITS)))
    if checkpoint is None:
        checkpoint = not stable_scan(df)
    # otherwise pin partition ids and positions with a reliable checkpoint
    return cut_lineage(tagged) if checkpoint else tagged


def with_row_index(df: DataFrame, name: str = "__source_row", start: int = 2,
                   checkpoint: bool | None = None) -> DataFrame:
    """Number rows ``start, start+1, …`` in scan order.

    Partition ids and in-partition positions must be the same in the count
    job and the numbering job (and after executor loss).  A plain file scan
    guarantees that by itself; any other input is first checkpointed
    (reliable, shared folder).  ``checkpoint=True/False`` forces the choice.
    """
    tagged = _tag(df, checkpoint)
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # one row per input partition: the window runs over a table whose size is
    # the partition count, never the data.
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    n_parts = tagged.rdd.getNumPartitions()
    numbered = join_small(tagged, offsets, "__pid", "inner", known_rows=n_parts)
    return numbered.withColumn(name, (F.col("__off") + F.col("__seq") + F.lit(start)).cast("long")) \
        .drop("__pid", "__seq", "__off")


def dense_position(df: DataFrame, order_col: str, name: str = "__position", partitions: int | None = None) -> DataFrame:
    """0-based dense position by a unique ``order_col``.

    Rows are range-partitioned by the key (bounds from a sample, so spread,
    hashed or dense keys give partitions alike) and sorted inside; the positions
    are those of ``with_row_index``: a prefix sum over one row a partition, and
    no window over the data."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, col(order_col)).sortWithinPartitions(col(order_col))
    return with_row_index(ordered, name, 0, checkpoint=True)


def exact_quantiles(df: DataFrame, value: Column | str, probs: list[float],
                    groups: list[str] | None = None, partitions: int | None = None,
                    size_hint: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` (nulls/NaN ignored).

    Returns ``groups…, p DOUBLE, q DOUBLE`` — one row per (group, prob) for
    groups with at least one value.  Plan: one range-partitioned sort of the
    single value column; a segment table of (#partitions × #groups) rows
    gives each segment its rank offset; only the 1–2 rows per (group, prob)
    that hold the interpolation ranks are joined back.
    """
    groups = list(groups or [])
    gcols = [col(g) for g in groups]
    v = col(value) if isinstance(value, str) else value
    vals = df.select(*gcols, v.cast("double").alias("__v")) \
        .where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    spark = df.sparkSession
    # Size-checked strategy, like a broadcast: Spark's exact ``percentile``
    # keeps a value→count map per group in one task, which is safe for a
    # checked number of values; beyond it, the range-partitioned ranks below.
    # ``size_hint``: a proven upper bound on the number of values (saves a count)
    if (size_hint if size_hint is not None else vals.count()) <= PERCENTILE_MAP_LIMIT:
        arr = vals.groupBy(*gcols).agg(F.percentile("__v", [float(p) for p in probs]).alias("__qs"))
        return arr.select(*groups, F.posexplode("__qs").alias("__i", "q")) \
            .select(*groups, F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1).alias("p"), "q")
    nparts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A salt after the value lets range bounds split a value that holds a
    # large share of rows; equal values are interchangeable for ranking.
    salt = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    ranked = (vals.withColumn("__salt", salt)
              .repartitionByRange(nparts, *gcols, F.col("__v"), F.col("__salt"))
              .sortWithinPartitions(*gcols, F.col("__v"), F.col("__salt"))
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id())
              .drop("__salt"))
    # Reliable checkpoint: range bounds, partition ids and positions are fixed
    # once, so the segment table and the pick below read the same ranks.
    from proofsheet.session import cut_lineage
    ranked = cut_lineage(ranked)
    seg = ranked.groupBy("__pid", *groups).agg(F.count(F.lit(1)).alias("__c"), F.min("__mid").alias("__m0"))
    # windows below run over the segment table only (#partitions × #groups rows)
    before = Window.partitionBy(*gcols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*gcols)
    seg = (seg.withColumn("__off", F.coalesce(F.sum("__c").over(before), F.lit(0)))
              .withColumn("__n", F.sum("__c").over(whole)))
    prob_arr = F.array(*[F.lit(float(p)) for p in probs])
    wanted = (seg.select("*", F.explode(prob_arr).alias("p"))
              .withColumn("__pos", F.col("p") * (F.col("__n") - 1))
              .withColumn("__frac", F.col("__pos") - F.floor("__pos"))
              .select("*", F.explode(F.array(
                  F.struct(F.lit("lo").alias("end"), F.floor("__pos").cast("long").alias("rank")),
                  F.struct(F.lit("hi").alias("end"), F.ceil("__pos").cast("long").alias("rank")),
              )).alias("__t"))
              .where((F.col("__t.rank") >= F.col("__off")) & (F.col("__t.rank") < F.col("__off") + F.col("__c")))
              .select("__pid", *groups, "p", "__frac", F.col("__t.end").alias("__end"),
                      (F.col("__m0") + F.col("__t.rank") - F.col("__off")).alias("__mid")))
    # ungrouped: exactly 1–2 rows per prob, a proven bound; grouped: counted
    bound = 2 * len(probs) if not groups else None
    picked = join_small(ranked.select("__pid", "__mid", "__v"), wanted, ["__pid", "__mid"], "inner", known_rows=bound)
    return picked.groupBy(*groups, "p").agg(
        F.max(F.when(F.col("__end") == "lo", F.col("__v"))).alias("__vlo"),
        F.max(F.when(F.col("__end") == "hi", F.col("__v"))).alias("__vhi"),
        F.max("__frac").alias("__frac"),
    ).select(*groups, "p", (F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * F.col("__frac")).alias("q"))


def with_file_row_index(df: DataFrame, file_col: str = "__source_file", name: str = "__source_row",
                        start: int = 2, checkpoint: bool | None = None) -> DataFrame:
    """W1 for a multi-file scan: the row number *within each file*.

    Spark may pack several small files into one partition or split a large
    file over several; rows of one file stay contiguous inside a partition
    and its splits come in partition order.  A segment table of
    (#files × #partitions) rows holds each segment's offset within its file.
    """
    tagged = _tag(df, checkpoint)
    seg = tagged.groupBy(col(file_col).alias("__f"), "__pid").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__s0"))
    before = Window.partitionBy("__f").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    seg = seg.withColumnRenamed("__f", file_col)
    numbered = join_small(tagged, seg, [file_col, "__pid"], "inner")
    return numbered.withColumn(name, (F.col("__off") + F.col("__seq") - F.col("__s0") + F.lit(start)).cast("long")) \
        .drop("__pid", "__seq", "__s0", "__off")
