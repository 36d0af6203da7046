"""Interactive exploration of the cleaned rows.

Filters push down to the scan when the working copy is a table; charts
re-aggregate with ``groupBy`` + top-k; pages come from a directory of sorted
ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import names as N
from proofsheet.functions.expr import all_of, col, utrim
from proofsheet.operators.metrics import aggregate
from proofsheet.session import saved


def cross_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """One dimension equals a value, compared as text."""
    return df.where(col(column).cast("string") == F.lit(value))


def equality_filters(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """AND of column = value; empty values mean "all"."""
    conds = [col(c).cast("string") == F.lit(v) for c, v in filters.items() if v not in (None, "")]
    return df.where(all_of(conds)) if conds else df


def global_search(df: DataFrame, query: str) -> DataFrame:
    """Case-insensitive text search over every data column."""
    cols = [c for c in df.columns if not c.startswith("__")]
    blob = F.lower(F.concat_ws("\u0001", *[col(c).cast("string") for c in cols]))
    return df.where(blob.contains(query.lower()))


def explore(df: DataFrame, dimension: str, measure: str, chart: str = "bar") -> DataFrame:
    """A30 + T6: re-aggregate any (dimension, measure) pair — skip a null or
    blank group or a non-number, sum (mean for percent-like names), limit 24
    periods for a line (label order, numbers first numerically), 8 for a
    donut, 10 for a bar (value desc)."""
    op = N.primary_aggregate(measure)
    label = col(dimension).cast("string")
    m = col(measure).cast("double")
    base = df.where(label.isNotNull() & (utrim(label) != "") & m.isNotNull())
    grouped = base.groupBy(label.alias("label")).agg(aggregate(op, m).alias("value"))
    if chart == "line":
        num = F.col("label").try_cast("double")
        return grouped.orderBy(num.asc_nulls_last(), F.col("label")).limit(24)
    limit = 8 if chart == "donut" else 10
    return grouped.orderBy(F.col("value").desc_nulls_last(), F.col("label")).limit(limit)


def selection_range(df: DataFrame, measure: str, filters: dict[str, str | None] | None = None) -> DataFrame:
    """Min / avg / max under the active selection."""
    sel = equality_filters(df, filters or {})
    m = col(measure)
    return sel.agg(F.min(m).cast("double").alias("min_value"), aggregate("average", m).alias("avg_value"),
                   F.max(m).cast("double").alias("max_value"))


def kpi_under_selection(df: DataFrame, operation: str, measure: str | None,
                        filters: dict[str, str | None] | None = None) -> DataFrame:
    """A KPI recomputed by its operation; ``count`` is the row count."""
    sel = equality_filters(df, filters or {})
    if operation == "count" or measure is None:
        return sel.agg(F.count(F.lit(1)).cast("double").alias("value"))
    return sel.agg(F.coalesce(aggregate(operation, col(measure)), F.lit(0.0)).alias("value"))


#: Rows of one range of a page directory, about.
RANGE_ROWS = 1 << 17


class PageDirectory:
    """The rows in the order of a sort column, the source row as
    tie-break, stored in ranges of about RANGE_ROWS, and the number of rows of
    each range.  A page reads the one or two ranges that hold it; the next page
    after a row is found by its key alone (``after``).  The driver holds one
    number a range."""

    def __init__(self, df: DataFrame, sort_col: str | None = None, descending: bool = False, src: str = "__source_row"):
        self.src, self.sort_col, self.descending, self.columns = src, sort_col, descending, df.columns
        keyed = df.withColumn("__key", col(sort_col) if sort_col else F.lit(0))
        ranges = max(1, -(-df.count() // RANGE_ROWS))
        self.rows = saved(keyed.repartitionByRange(ranges, *self.order()).sortWithinPartitions(*self.order()).withColumn("__part", F.spark_partition_id()))
        self.counts = sorted((r["__part"], r["n"]) for r in self.rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())

    def order(self) -> list:
        key = F.col("__key")
        return [key.desc_nulls_last() if self.descending else key.asc_nulls_last(), col(self.src).asc()]

    def page(self, page: int = 0, size: int = 50) -> DataFrame:
        first, before, wanted = page * size, 0, []
        for part, n in self.counts:
            if before < first + size and before + n > first:
                wanted.append((part, first - before, first + size - before))
            before += n
        inside = Window.partitionBy("__part").orderBy(*self.order())
        rows = self.rows.where(F.col("__part").isin([part for part, _, _ in wanted])).withColumn("__at", F.row_number().over(inside) - 1)
        here = F.lit(False)
        for part, a, b in wanted:
            here = here | (F.col("__part") == part) & (F.col("__at") >= a) & (F.col("__at") < b)
        return rows.where(here).orderBy(*self.order()).select(*[col(c) for c in self.columns])

    def after(self, key, source_row: int, size: int = 50) -> DataFrame:
        """The rows behind the one with this key and source row."""
        k, row = F.col("__key"), col(self.src)
        if key is None:
            behind = k.isNull() & (row > source_row)
        else:
            behind = k.isNull() | ((k < F.lit(key)) if self.descending else (k > F.lit(key))) | (k == F.lit(key)) & (row > source_row)
        return self.rows.where(behind).orderBy(*self.order()).limit(size).select(*[col(c) for c in self.columns])


def sorted_page(df: DataFrame, sort_col: str | None = None, descending: bool = False, page: int = 0,
                size: int = 50, src: str = "__source_row") -> DataFrame:
    """One page by column sort with the source row as tie-break.  Who
    asks for several pages keeps the ``PageDirectory``."""
    return PageDirectory(df, sort_col, descending, src).page(page, size)


def repaired_cells(df: DataFrame, actions: DataFrame, src: str = "__source_row") -> DataFrame:
    """Rows with the array of columns repaired by a non-retained action."""
    rep = (actions.where(F.col("strategy") != "retained")
           .groupBy(F.col("source_row").alias(src)).agg(F.array_sort(F.collect_set("column")).alias("repaired_columns")))
    return df.join(rep, src, "left").withColumn("repaired_columns", F.coalesce("repaired_columns", F.array().cast("array<string>")))
