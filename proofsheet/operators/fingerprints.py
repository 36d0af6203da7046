"""Equal rows found by fingerprints.

A row's fingerprint is a 64-bit hash over its columns and their null marks,
its digest a SHA-256 over the same values.  One light shuffle groups source
rows by fingerprint.  Where all digests of a group are the same it is a group of
equal rows; the rows of other groups, whose fingerprints collide, are compared
column by column.  Whole rows are shuffle keys for such rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions.expr import col
from proofsheet.operators.positions import join_small
from proofsheet.session import saved


def comparable(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as values that are the same where ``GROUP BY`` holds them equal: one zero, one NaN."""
    out = []
    for name in columns:
        c, dt = col(name), df.schema[name].dataType
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), F.lit(float("nan")).cast(dt)).when(c == 0, F.lit(0.0).cast(dt)).otherwise(c)
        out.append(c)
    return out


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    values = comparable(df, columns)
    return F.xxhash64(*[x for v in values for x in (v.isNull(), v)]) if values else F.lit(0).cast("long")


def digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the values, each with its length in front, nulls told apart."""
    texts = [c.cast("string") if isinstance(df.schema[n].dataType, T.AtomicType) else F.to_json(F.struct(c)) for n, c in zip(columns, comparable(df, columns))]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat_ws("", *parts), 256)) if parts else F.lit(b"")


def marked(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return df.select(fingerprint(df, columns).alias("fp"), digest(df, columns).alias("dg"), *more)


def repeated(marks: DataFrame, *aggs: Column) -> DataFrame:
    """(fp, n, mixed, ...) of the fingerprints of several rows; ``mixed``: not all of them are equal."""
    return marks.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), (F.min("dg") != F.max("dg")).alias("mixed"), *aggs).where("n > 1")


def groups(df: DataFrame, columns: list[str], src: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first, removed): of every group of equal rows its smallest source row,
    the number of its rows ``n`` and the sums of ``carry``; the source rows of the others."""
    marks = saved(marked(df, columns, col(src).alias("src"), *[F.col(c).cast("long").alias(c) for c in carry]))
    sums = [F.sum(c).alias(c) for c in carry]
    several = saved(repeated(marks, F.min("src").alias("first"), *sums))
    equal = several.where(~F.col("mixed"))
    removed = join_small(marks.select("fp", "src"), equal.select("fp", "first"), "fp").where("src > first").select(F.col("src").alias(src))
    first = equal.select(F.col("first").alias(src), "n", *carry)
    mixed = several.where("mixed").select("fp")
    if mixed.isEmpty():
        return first, removed
    # colliding fingerprints: their rows, compared whole
    suspects = join_small(marks.select("fp", F.col("src").alias(src)), mixed, "fp").select(src)
    keys = [c.alias(f"k{i}") for i, c in enumerate(comparable(df, columns))]
    rows = saved(join_small(df, suspects, src).select(*keys, col(src).alias("src"), *[F.col(c).cast("long").alias(c) for c in carry]))
    names = [f"k{i}" for i in range(len(columns))]
    whole = rows.groupBy(*names).agg(F.min("src").alias("first"), F.count(F.lit(1)).alias("n"), *sums).where("n > 1")
    same = [rows[n].eqNullSafe(whole[n]) for n in names]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    again = rows.join(whole, condition).where("src > first").select(rows["src"].alias(src))
    return first.unionByName(whole.select(F.col("first").alias(src), "n", *carry)), removed.unionByName(again)


def repeats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(duplicate_rows): rows that repeat an earlier one."""
    several = saved(repeated(marked(df, columns)))
    equal = several.where(~F.col("mixed")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    mixed = several.where("mixed").select("fp")
    if mixed.isEmpty():
        return equal
    suspects = join_small(df.withColumn("fp", fingerprint(df, columns)), mixed, "fp")
    whole = suspects.groupBy(*[col(c) for c in columns]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    return equal.unionByName(whole).agg(F.sum("duplicate_rows").alias("duplicate_rows"))
