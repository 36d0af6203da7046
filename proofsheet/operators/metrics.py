"""Aggregate metrics: KPIs, category top-k, time trend, range, registry.

A1–A10, A29–A33, T1–T3, T9, S14.  All global KPIs of a dataset come from ONE
aggregate (the reference issues one query per number); each chart is one
``groupBy`` whose top-k is a ``TakeOrderedAndProject`` (map-side partial
top-k, no global sort).

Numeric policy: sums accumulate in ``DECIMAL(38, 6)`` so a result does not
depend on partitioning or summation order; averages are that exact sum
divided by the count.  ``min``/``max`` are order-independent already.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions import names as N
from proofsheet.functions import vocab as V
from proofsheet.functions.expr import as_label, col, period_label

SUM_SCALE = 6

RESULTS_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("operation", T.StringType()),
    T.StructField("source_columns", T.ArrayType(T.StringType())),
    T.StructField("query", T.StringType()),
])


def sum_parts(c: Column) -> tuple[Column, Column]:
    """A value as its first SUM_SCALE decimals, which add up exactly in any
    order, and what that leaves of it (0 for values of fewer decimals; all of
    a value beyond the decimal range)."""
    x = c.cast("double")
    part = F.when(F.abs(x) < 1e20, x.cast(f"decimal(38,{SUM_SCALE})")).otherwise(F.lit(0).cast(f"decimal(38,{SUM_SCALE})"))
    return F.when(x.isNotNull(), part), x - part.cast("double")


def exact_sum(c: Column) -> Column:
    """Sum without loss: digits beyond the exact part are summed beside it."""
    part, rest = sum_parts(c)
    return F.sum(part).cast("double") + F.sum(rest)


def aggregate(op: str, c: Column) -> Column:
    """Column aggregate for ``sum | average | min | max | count``."""
    if op == "sum":
        return exact_sum(c)
    if op == "average":
        return exact_sum(c) / F.count(c).cast("double")
    if op == "min":
        return F.min(c).cast("double")
    if op == "max":
        return F.max(c).cast("double")
    if op == "count":
        return F.count(c).cast("double")
    raise ValueError(f"unsupported aggregation {op}")


def registry_round(c: Column, dp: int = V.RESULT_DP) -> Column:
    return F.round(c, dp)


@dataclass(frozen=True)
class Kpi:
    id: str
    label: str
    key: str
    operation: str
    measure: str
    format: str


_PREFIX = {"sum": "Total", "average": "Average", "max": "Highest", "min": "Lowest"}


def plan_kpis(measures: list[str]) -> list[Kpi]:
    """A2–A5: every KPI a table could show, in order of preference (primary
    aggregates, then other aggregates by measure, then fallbacks); the first
    MAX_KPIS of them, each id once."""
    def kpi(id_: str, key: str, op: str, m: str) -> Kpi:
        return Kpi(f"{id_}-{m}", f"{_PREFIX[op]} {m}", f"{key}.{m}", op, m, N.display_format(m))

    primary = {m: N.primary_aggregate(m) for m in measures}
    offers = [kpi("metric", "sum" if op == "sum" else f"metric.{op}", op, m) for m, op in primary.items()]
    offers += [kpi(op, f"metric.{op}", op, m) for m in measures for op in ("average", "max", "min") if op != primary[m]]
    offers += [kpi(op, f"metric.fallback.{op}", op, m) for m in measures for op in _PREFIX]
    ids = [k.id for k in offers]
    return [k for i, k in enumerate(offers) if ids.index(k.id) == i][:V.MAX_KPIS]


def registry_rows(one_row: DataFrame, entries: list[tuple[str, str, str, list[str], str]]) -> DataFrame:
    """Turn columns of a one-row aggregate into registry rows.

    ``entries``: (column, key, operation, source_columns, query)."""
    if not entries:
        return one_row.sparkSession.createDataFrame([], RESULTS_SCHEMA)
    structs = [F.struct(F.lit(key).alias("key"), registry_round(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("value"),
                        F.lit(op).alias("operation"), F.array(*[F.lit(s) for s in src]).cast("array<string>").alias("source_columns"),
                        F.lit(q).alias("query"))
               for c, key, op, src, q in entries]
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def kpi_aggs(measures: list[str]) -> tuple[list[Column], list, list[Kpi]]:
    """A1–A5 as aggregate Columns + their registry entries."""
    kpis = plan_kpis(measures)
    aggs = [F.count(F.lit(1)).cast("double").alias("__rows")]
    entries = [("__rows", "rows.total", "count", [], "count(*)")]
    for i, k in enumerate(kpis):
        aggs.append(aggregate(k.operation, col(k.measure)).alias(f"__k{i}"))
        entries.append((f"__k{i}", k.key, k.operation, [k.measure], f"agg({k.operation}(`{k.measure}`))"))
    return aggs, entries, kpis


def kpi_frame(df: DataFrame, measures: list[str]) -> tuple[DataFrame, list[Kpi]]:
    """A1–A5 in one aggregate: row count + every KPI → registry rows."""
    aggs, entries, kpis = kpi_aggs(measures)
    return registry_rows(df.agg(*aggs), entries), kpis


def range_aggs(measure: str) -> list[Column]:
    """A7 as aggregate Columns (``min_value, avg_value, max_value``)."""
    c = col(measure)
    return [F.min(c).cast("double").alias("min_value"), aggregate("average", c).alias("avg_value"),
            F.max(c).cast("double").alias("max_value")]


def one_row(spark, values: dict, names: list[str]) -> DataFrame:
    """A one-row DataFrame of already-aggregated doubles."""
    schema = ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame([tuple(None if values[n] is None else float(values[n]) for n in names)], schema)


def category_topk(df: DataFrame, dimension: str, measures: list[str], k: int = V.CATEGORY_TOP_K) -> DataFrame:
    """A8 + T1: group by one category (nulls out), ≤ 2 measures with their
    primary aggregate, top ``k`` by the first measure desc (label tie-break).

    Returns ``rank, category, value_0[, value_1]`` (rank is 0-based)."""
    dt = df.schema[dimension].dataType
    ms = measures[:2]
    grouped = (df.where(col(dimension).isNotNull())
               .groupBy(as_label(col(dimension), dt).alias("category"))
               .agg(*[aggregate(N.primary_aggregate(m), col(m)).alias(f"value_{i}") for i, m in enumerate(ms)]))
    top = grouped.orderBy(F.col("value_0").desc_nulls_last(), F.col("category").asc()).limit(k)
    return _ranked(top, [F.col("value_0").desc_nulls_last(), F.col("category").asc()], "rank")


def _ranked(small: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows of an already-limited (≤ k rows) result."""
    from pyspark.sql import Window
    return small.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def trend(df: DataFrame, time_columns: list[str], measures: list[str], is_date: bool,
          k: int = V.TREND_PERIODS, latest: bool = False) -> DataFrame:
    """A9/A10 + T3 (+P19/P20): monthly trend of the first date column, or
    group by 1–2 temporal dimensions; the earliest ``k`` periods ascending
    (``latest=True`` keeps the most recent ``k``)."""
    ms = measures[:2]
    if is_date:
        keys = [period_label(col(time_columns[0])).alias("__t0")]
        tcols = time_columns[:1]
    else:
        tcols = time_columns[:2]
        keys = [col(t).alias(f"__t{i}") for i, t in enumerate(tcols)]
    names = [f"__t{i}" for i in range(len(keys))]
    grouped = (df.where(F.lit(True) if not tcols else _not_null(tcols))
               .groupBy(*keys)
               .agg(*[aggregate(N.primary_aggregate(m), col(m)).alias(f"value_{i}") for i, m in enumerate(ms)]))
    order = [F.col(n).asc_nulls_last() for n in names]
    if latest:
        top = grouped.orderBy(*[F.col(n).desc_nulls_last() for n in names]).limit(k)
    else:
        top = grouped.orderBy(*order).limit(k)
    label = F.col("__t0").cast("string") if len(names) == 1 else F.concat_ws(" · ", *[F.col(n).cast("string") for n in names])
    out = _ranked(top, order, "ordinal").withColumn("period", label)
    return out.select("ordinal", "period", *[f"value_{i}" for i in range(len(ms))])


def _not_null(names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & col(n).isNotNull()
    return cond


def value_range(df: DataFrame, measure: str) -> DataFrame:
    """``min, avg, max`` of one measure (A31 under a prior filter)."""
    return df.agg(*range_aggs(measure))


def chart_registry(points: DataFrame, prefix: str, value_cols: list[str], operation: list[str],
                   sources: list[list[str]], index_col: str) -> DataFrame:
    """Registry rows ``{prefix}.{series}.{index}`` for each chart point."""
    parts = []
    for s, vc in enumerate(value_cols):
        parts.append(points.select(
            F.concat(F.lit(f"{prefix}.{s}."), F.col(index_col).cast("string")).alias("key"),
            registry_round(F.coalesce(F.col(vc), F.lit(0.0))).alias("value"),
            F.lit(operation[s]).alias("operation"),
            F.array(*[F.lit(x) for x in sources[s]]).alias("source_columns"),
            F.lit(f"{prefix} groupBy/agg/orderBy/limit").alias("query"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def formula_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """``coalesce(sum(col), 0)`` of every referenced measure, one row."""
    return df.agg(*[F.coalesce(exact_sum(col(c)), F.lit(0.0)).alias(c) for c in columns])
