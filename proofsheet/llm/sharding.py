"""Operator 7: shards by jump consistent hashing.

A stable key decides the shard without a ring table: the key seeds a linear
congruential sequence whose jumps end in the last bucket below the shard
count.  One more shard takes rows from the others and moves none between them.
Everything is Column arithmetic in one pass over the rows, without a shuffle.

Defined results: a null key is one key of its own; repeated keys share a
shard; an empty table gives an empty result; a column of the input that bears
an output's name is replaced by the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from proofsheet.session import saved

#: Multiplier of the published generator (fixed value).
MULTIPLIER = 2862933555777941757
#: 64-bit state as limbs of 22, 22 and 20 bits: products stay far below 2^63.
LIMB, MASK, TOP = 22, (1 << 22) - 1, (1 << 20) - 1
#: Jumps tried at first; a key needs ln(shards) on average.
FIRST_STEPS = 48


def stable_key(column: Column) -> Column:
    return F.xxhash64(column.cast("string"))


def _advance(s: Column) -> tuple[Column, Column, Column]:
    """state * MULTIPLIER + 1 modulo 2^64, limb by limb."""
    c = [F.lit(MULTIPLIER >> (LIMB * i) & MASK).cast("long") for i in range(3)]
    r0 = s["k0"] * c[0] + 1
    r1 = s["k0"] * c[1] + s["k1"] * c[0] + F.shiftright(r0, LIMB)
    r2 = s["k0"] * c[2] + s["k1"] * c[1] + s["k2"] * c[0] + F.shiftright(r1, LIMB)
    return r0.bitwiseAND(F.lit(MASK)), r1.bitwiseAND(F.lit(MASK)), r2.bitwiseAND(F.lit(TOP))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def state(k0, k1, k2, b, j):
        return F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), b.cast("long").alias("b"), j.cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["j"] < shards, jumped(s)).otherwise(s)

    def jumped(s: Column) -> Column:
        # nested one-element transform: the advanced limbs are computed once and read by name
        k0, k1, k2 = _advance(s)
        limbs = F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), s["j"].alias("b"))
        return F.transform(F.array(limbs), lambda n: state(
            n["k0"], n["k1"], n["k2"], n["b"],
            F.floor((n["b"] + 1).cast("double")
                    * (F.lit(2147483648.0) / (F.shiftleft(n["k2"], 11) + F.shiftright(n["k1"], 11) + 1).cast("double")))))[0]

    first = state(key.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(key, LIMB).bitwiseAND(F.lit(MASK)),
                  F.shiftrightunsigned(key, 2 * LIMB), F.lit(-1), F.lit(0))
    steps = min(shards, FIRST_STEPS)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)
    if shards > steps:  # no key is cut short: the rest of the jumps, for the keys that need them
        done = F.transform(F.array(done), lambda s: F.when(
            s["j"] < shards, F.aggregate(F.sequence(F.lit(1), F.lit(shards)), s, step)).otherwise(s))[0]
    return done["b"].cast("int")


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Every row with its shard in column ``name``."""
    return df.withColumn(name, jump_hash(stable_key(F.col(key)), shards))


def with_slots(df: DataFrame, shard: str = "shard", order: tuple[str, ...] = (), name: str = "slot") -> DataFrame:
    """Positions 0.. without gaps within each shard.

    Rows are numbered within (shard, input partition), so that no window holds
    more than one input partition's rows, and moved up by the counts of the
    partitions before.  The numbered rows are written first: both uses see the
    same partitions, also after a lost executor."""
    df = saved(df.withColumn("__part", F.spark_partition_id()))
    before = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = (df.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
              .select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    own = W.partitionBy(shard, "__part").orderBy(*order)
    return (df.withColumn("__row", F.row_number().over(own)).join(starts, [shard, "__part"])
            .withColumn(name, (F.col("__start") + F.col("__row") - 1).cast("long"))
            .drop("__part", "__row", "__start"))


def shard_index(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, size, checksum, shard, slot, and the shard
    with one more shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), jump_hash(stable_key(F.col(key)), shards).alias("shard"),
        jump_hash(stable_key(F.col(key)), shards + 1).alias("grown_shard"))
    return with_slots(rows, order=(key, "text_crc32", "size")).select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
