"""Verification joins.

J1/J2 recompute a grouped result through a second physical path (double
sums instead of exact decimal sums) and join on the typed key with
null-safe equality; J3 checks every referenced result exists; J4 checks the
numbers quoted in free text against the registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.functions import vocab as V
from proofsheet.functions.expr import col


class VerificationError(ValueError):
    pass


def isclose(a, b, rel: float = V.RECONCILE_REL_TOL, abs_: float = V.RECONCILE_ABS_TOL):
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def second_path(op: str, c):
    """The same aggregate computed on plain doubles (different physical path)."""
    c = c.cast("double")
    return {"sum": F.sum(c), "average": F.avg(c), "min": F.min(c), "max": F.max(c), "count": F.count(c).cast("double")}[op]


def _full_keys(keys: list[str], how: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """A null-safe join on ``keys``; ``__in_left`` and ``__in_right`` tell the sides, the keys come from the side that has them."""
    left = left.withColumn("__in_left", F.lit(True))
    right = right.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[col(c) for c in right.columns if c not in keys], F.lit(True).alias("__in_right"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & col(k).eqNullSafe(F.col(f"__k{i}"))
    j = left.join(right, cond, how)
    for i, k in enumerate(keys):
        j = j.withColumn(k, F.when(F.col("__in_left"), col(k)).otherwise(F.col(f"__k{i}")))
    return j.drop(*[f"__k{i}" for i in range(len(keys))])


def reconcile(result: DataFrame, df: DataFrame, keys: list[str], value_col: str, op: str, measure: str, complete: bool = False) -> DataFrame:
    """Rows of ``result`` whose value disagrees with an independent
    recomputation or whose group the data does not have; with ``complete`` (the
    result is no top-k) also the groups of the data that ``result`` lacks.
    Empty ⇒ ok."""
    other = df.groupBy(*[col(k) for k in keys]).agg(F.coalesce(second_path(op, col(measure)), F.lit(0.0)).alias("__check"))
    if not keys:
        check = other.collect()[0]["__check"]
        bad = result.where(~isclose(F.coalesce(F.col(value_col), F.lit(0.0)), F.lit(check)))
        return bad.select(F.col(value_col), F.lit(check).alias("__check"))
    j = _full_keys(keys, "full" if complete else "left", result, other)
    missing = F.col("__in_left").isNull() | F.col("__in_right").isNull()
    bad = j.where(missing | ~isclose(F.coalesce(F.col(value_col), F.lit(0.0)), F.col("__check")))
    return bad.select(*[col(k) for k in keys], F.col(value_col), F.col("__check"))


def group_checksums(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, rows, checksum): per group its rows and the sum of their hashes, which no order of rows changes."""
    marks = [x for c in columns for x in (col(c).isNull(), col(c))]
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"),
                                                   F.sum(F.xxhash64(*marks).cast("decimal(38,0)")).alias("checksum"))


def compare_groups(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Groups in which two tables differ: ``keys``, ``difference`` (missing
    left, missing right, altered), ``left_rows``, ``right_rows``.  One null-safe
    full outer join of the groups' checksums; no row leaves its group."""
    a = group_checksums(left, keys, columns).withColumnsRenamed({"rows": "left_rows", "checksum": "__l"})
    b = group_checksums(right, keys, columns).withColumnsRenamed({"rows": "right_rows", "checksum": "__r"})
    difference = F.when(F.col("__in_left").isNull(), "missing left").when(F.col("__in_right").isNull(), "missing right").when(
        (F.col("left_rows") != F.col("right_rows")) | (F.col("__l") != F.col("__r")), "altered")
    return _full_keys(keys, "full", a, b).select(*[col(k) for k in keys], difference.alias("difference"), "left_rows", "right_rows").where("difference is not null")


def assert_reconciled(bad: DataFrame) -> None:
    rows = bad.limit(5).collect()
    if rows:
        raise VerificationError(f"independent recomputation disagrees: {rows}")


def missing_refs(refs: DataFrame, results: DataFrame) -> DataFrame:
    """``ref`` values of ``refs`` (a column of arrays or strings named
    ``result_refs``/``ref``) absent from the registry."""
    if "result_refs" in refs.columns:
        refs = refs.select(F.explode("result_refs").alias("ref"))
    return refs.join(results.select(F.col("key").alias("ref")), "ref", "left_anti")


#: Plain, grouped by thousands, or scientific.
NUMBER_IN_PROSE = r"(?<![\w.,])-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:[,.]\d+)?(?:[eE][+-]?\d+)?(?![\w]|[.,]\d)"


def unproven_numbers(texts: DataFrame, results: DataFrame, text_col: str = "text") -> DataFrame:
    """Numbers quoted in prose (outside «…») that equal no registry
    value.  A number right before a full stop is checked too."""
    prose = F.regexp_replace(F.col(text_col), "«[^»]*»", "")
    nums = texts.select(F.explode(F.regexp_extract_all(prose, F.lit(NUMBER_IN_PROSE), 0)).alias("raw"))
    nums = nums.withColumn("num", F.regexp_replace("raw", ",", "").try_cast("double"))
    known = results.select(F.col("value").alias("num")).where(F.col("num").isNotNull()).distinct()
    return nums.join(known, "num", "left_anti").select("raw")


def verified_summary(items: DataFrame, results: DataFrame) -> DataFrame:
    """Each item (with ``result_refs``) joined to its registry values."""
    ex = items.select("*", F.explode("result_refs").alias("__ref"))
    j = ex.join(results.select(F.col("key").alias("__ref"), "value", "operation"), "__ref", "inner")
    keys = [c for c in items.columns if c != "result_refs"]
    return j.groupBy(*keys).agg(F.collect_list(F.struct(F.col("__ref").alias("key"), "value", "operation")).alias("values"))
