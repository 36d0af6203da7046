"""Charts, filter values and selections from one scan.

``roll_up`` reads the rows once and aggregates every grouping set that charts
and filters need in one partial aggregation.  What it stores per group are
mergeable states (exact sum, rest, count, smallest, largest, rows, first source
row), so that any coarser grouping, and any selection by equality on the keys
of a stored set, is answered from the roll-up without the rows.

Nulls are groups of their own in the roll-up; the charts leave them out.  An
empty table gives empty charts.  Data columns named ``__…`` are the library's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.functions import names as N
from proofsheet.functions import vocab as V
from proofsheet.functions.expr import all_of, as_label, col, utrim
from proofsheet.operators.metrics import _not_null, _ranked, sum_parts
from proofsheet.session import saved

SRC = "__source_row"

#: Groups that a set kept for selections may have at most, by the product of
#: its keys' exact distinct counts (nulls included).
SELECTION_GROUPS = 1 << 20


@dataclass(frozen=True)
class RollUp:
    """The stored states: ``frame`` has ``__set`` (grouping id), one typed
    column per key and the states of the measures."""
    frame: DataFrame
    keys: tuple[str, ...]
    sets: tuple[tuple[str, ...], ...]
    measures: tuple[str, ...]

    def covers(self, *columns: str) -> bool:
        return any(set(columns) <= set(s) for s in self.sets)

    def states(self, *columns: str) -> DataFrame:
        """The states of the smallest stored set that has all ``columns``."""
        fit = [s for s in self.sets if set(columns) <= set(s)]
        if not fit:
            raise KeyError(f"the roll-up holds no set with {sorted(columns)}")
        return self.frame.where(F.col("__set") == grouping_id(self.keys, min(fit, key=len)))

    def value(self, op: str, measure: str) -> Column:
        """The aggregate of a measure over the states of a group."""
        i = self.measures.index(measure)
        total = F.sum(f"__part{i}").cast("double") + F.sum(f"__rest{i}")
        return {"sum": total, "average": total / F.sum(f"__count{i}").cast("double"), "min": F.min(f"__low{i}"),
                "max": F.max(f"__high{i}"), "count": F.sum(f"__count{i}").cast("double")}[op]

    def _primary(self, measures: list[str]) -> list[Column]:
        return [self.value(N.primary_aggregate(m), m).alias(f"value_{i}") for i, m in enumerate(measures[:2])]

    def category_topk(self, dimension: str, measures: list[str], k: int = V.CATEGORY_TOP_K) -> DataFrame:
        """A8 + T1, as ``metrics.category_topk``, from the states."""
        dt = self.frame.schema[dimension].dataType
        grouped = (self.states(dimension).where(col(dimension).isNotNull())
                   .groupBy(as_label(col(dimension), dt).alias("category")).agg(*self._primary(measures)))
        order = [F.col("value_0").desc_nulls_last(), F.col("category").asc()]
        return _ranked(grouped.orderBy(*order).limit(k), order, "rank")

    def trend(self, time_keys: list[str], measures: list[str], k: int = V.TREND_PERIODS) -> DataFrame:
        """A9/A10 + T3, as ``metrics.trend``: the earliest ``k`` periods.  The
        month of a date is a derived key of the roll-up."""
        keys = time_keys[:2]
        names = [f"__t{i}" for i in range(len(keys))]
        grouped = (self.states(*keys).where(_not_null(keys)).groupBy(*[col(t).alias(n) for t, n in zip(keys, names)])
                   .agg(*self._primary(measures)))
        order = [F.col(n).asc_nulls_last() for n in names]
        out = _ranked(grouped.orderBy(*order).limit(k), order, "ordinal")
        return out.select("ordinal", F.concat_ws(" · ", *[F.col(n).cast("string") for n in names]).alias("period"),
                          *[f"value_{i}" for i in range(len(measures[:2]))])

    def first_values(self, column: str, k: int = V.FILTER_VALUES) -> DataFrame:
        """The first ``k`` values of a column by first appearance:
        ``column, value, __first``."""
        return (self.states(column).where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value"))
                .agg(F.min("__first").alias("__first")).orderBy("__first").limit(k)
                .select(F.lit(column).alias("column"), "value", "__first"))

    def _selected(self, columns: list[str], filters: dict[str, str | None] | None) -> DataFrame:
        active = {c: v for c, v in (filters or {}).items() if v not in (None, "")}
        return self.states(*columns, *active).where(all_of([col(c).cast("string") == F.lit(v) for c, v in active.items()]))

    def explore(self, dimension: str, measure: str, chart: str = "bar", filters: dict[str, str | None] | None = None) -> DataFrame:
        """A30 + T6 under a selection (P33, P34), as ``explore.explore`` over
        the selected rows: ``label, value``."""
        i = self.measures.index(measure)
        label = col(dimension).cast("string")
        grouped = (self._selected([dimension], filters).where(label.isNotNull() & (utrim(label) != "") & (F.col(f"__count{i}") > 0))
                   .groupBy(label.alias("label")).agg(self.value(N.primary_aggregate(measure), measure).alias("value")))
        if chart == "line":
            return grouped.orderBy(F.col("label").try_cast("double").asc_nulls_last(), F.col("label")).limit(24)
        return grouped.orderBy(F.col("value").desc_nulls_last(), F.col("label")).limit(8 if chart == "donut" else 10)

    def selection_range(self, measure: str, filters: dict[str, str | None] | None = None) -> DataFrame:
        """A31 from the states."""
        return self._selected([], filters).agg(self.value("min", measure).alias("min_value"), self.value("average", measure).alias("avg_value"),
                                               self.value("max", measure).alias("max_value"))

    def kpi(self, operation: str, measure: str | None = None, filters: dict[str, str | None] | None = None) -> DataFrame:
        """A32 from the states; ``count`` is the number of rows."""
        rows = self._selected([], filters)
        if operation == "count" or measure is None:
            return rows.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("double").alias("value"))
        return rows.agg(F.coalesce(self.value(operation, measure), F.lit(0.0)).alias("value"))


def grouping_id(keys: tuple[str, ...], chosen: tuple[str, ...]) -> int:
    """Spark's grouping id: a bit per key, the first key's highest, 1 where the
    set leaves the key out."""
    return reduce(lambda a, k: a * 2 + (k not in chosen), keys, 0)


def selection_set(unique_counts: dict[str, int], bound: int = SELECTION_GROUPS) -> list[str]:
    """The keys, fewest values first, that one set for selections can hold
    within ``bound`` groups; a key's null counts as a value."""
    chosen, groups = [], 1
    for name, n in sorted(unique_counts.items(), key=lambda x: x[1]):
        groups *= n + 1
        if groups > bound:
            break
        chosen.append(name)
    return chosen


def roll_up(df: DataFrame, sets: list[list[str]], measures: list[str], derived: dict[str, Column] | None = None,
            src: str = SRC) -> RollUp:
    """One scan of ``df``: the states of ``measures`` for every set of key
    columns (of ``df`` or ``derived``), stored with each file's rows in the
    order of their set, so that readers skip other sets.  ``src`` may be
    absent: first rows are null then."""
    derived = derived or {}
    keys = tuple(dict.fromkeys(k for s in sets for k in s))
    chosen = tuple(dict.fromkeys(tuple(k for k in keys if k in s) for s in sets))
    columns = [derived.get(k, col(k)).alias(f"__key{i}") for i, k in enumerate(keys)]
    for i, m in enumerate(measures):
        part, rest = sum_parts(col(m))
        columns += [part.alias(f"__part{i}"), rest.alias(f"__rest{i}"), col(m).cast("double").alias(f"__value{i}")]
    first = col(src).cast("long") if src in df.columns else F.lit(None).cast("long")
    base = df.select(*columns, first.alias("__first"))
    states = [F.count(F.lit(1)).alias("__n"), F.min("__first").alias("__first")]
    for i in range(len(measures)):
        states += [F.sum(f"__part{i}").alias(f"__part{i}"), F.sum(f"__rest{i}").alias(f"__rest{i}"), F.count(f"__value{i}").alias(f"__count{i}"),
                   F.min(f"__value{i}").alias(f"__low{i}"), F.max(f"__value{i}").alias(f"__high{i}")]
    stored = [f"__key{i}" for i in range(len(keys))]
    if stored:
        grouped = base.groupingSets([[F.col(f"__key{keys.index(k)}") for k in s] for s in chosen], *[F.col(c) for c in stored]) \
            .agg(F.grouping_id().cast("long").alias("__set"), *states)
    else:
        grouped = base.agg(F.lit(0).cast("long").alias("__set"), *states)
    frame = saved(grouped.sortWithinPartitions("__set"))
    return RollUp(frame.withColumnsRenamed(dict(zip(stored, keys))), keys, chosen or ((),), tuple(measures))
