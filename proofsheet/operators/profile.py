"""Column profiling and role inference.

Statistics come from ONE wide aggregate (null counts, parse successes) plus
one distinct pass; the role rules then run over the resulting rows — one per
column, never per data row.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions import names as N
from proofsheet.functions import vocab as V
from proofsheet.functions.expr import COLUMN_DATE_FORMATS, col, date_text, is_numeric_type, is_temporal_type, parse_date_as, parse_numeric


@dataclass
class ColumnProfile:
    name: str
    inferred_type: str
    semantic_role: str
    null_count: int = 0
    unique_count: int = 0
    sample_values: list = field(default_factory=list)
    ambiguous: bool = False
    reason: str = ""
    unique_exact: bool = True


PROFILE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("inferred_type", T.StringType()),
    T.StructField("semantic_role", T.StringType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
    T.StructField("ambiguous", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("unique_exact", T.BooleanType()),
])


def _is_null(c, dt):
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


CHUNK = 50                       # columns per profiling aggregate
BITMAP_SPREAD = 16               # bits of range a value may cost in a bitmap count


def distinct_counts(df: DataFrame, columns: list[int], names: list[str], ranges: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    """Exact distinct values per column ordinal, without a row per cell.

    Each column is an aggregate of its own that reads that column alone, in
    batches of CHUNK.  Whole numbers whose range is narrow for their number of
    values (``ranges``: least, greatest, present) go into bitmaps, one of 32,768
    bits a bucket, OR-ed before and after the shuffle; of other columns the
    distinct values are aggregated map-side and counted in hash buckets."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    out: dict[int, int] = {}
    for start in range(0, len(columns), CHUNK):
        counts = None
        for i in columns[start:start + CHUNK]:
            c, dt = col(names[i]), fields[names[i]]
            present = df.where(~_is_null(c, dt))
            lo, hi, n = ranges.get(i, (0, 0, 0))
            if n and hi - lo <= BITMAP_SPREAD * n:
                v = c.cast("long")
                buckets = present.groupBy(F.bitmap_bucket_number(v).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("m"))
                one = buckets.agg(F.coalesce(F.sum(F.bitmap_count("m")), F.lit(0)).alias("n"))
            else:
                value = c if isinstance(dt, T.AtomicType) else F.to_json(F.struct(c))  # maps have no equality
                one = present.select(value.alias("v")).groupBy("v").agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias("n"))
            one = one.select(F.lit(i).alias("ordinal"), F.col("n").cast("long").alias("n"))
            counts = one if counts is None else counts.unionByName(one)
        out.update({r["ordinal"]: r["n"] for r in counts.collect()})  # a row per column
    return out


def column_stats(df: DataFrame, columns: list[str] | None = None, distinct: str = "exact") -> DataFrame:
    """A13/A14/P4 per column: ``ordinal, column, rows, null_count,
    present_count, numeric_count, unique_count, unique_exact``.

    ``distinct``: ``"exact"`` (default) counts every column exactly
    (``distinct_counts``); ``"approx"`` uses HyperLogLog inside the single wide
    aggregate and says so in ``unique_exact``.
    """
    columns = columns or [c for c in df.columns if not c.startswith("__")]
    fields = {f.name: f.dataType for f in df.schema.fields}
    df = df.select(*[col(c) for c in columns])
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    # Batches of CHUNK columns keep each generated aggregate small enough for
    # the JIT; on a columnar source every batch reads only its own columns.
    wide: dict = {}
    for start in range(0, max(len(columns), 1), CHUNK):
        aggs = [F.count(F.lit(1)).alias("rows")] if start == 0 else []
        for i, name in enumerate(columns[start:start + CHUNK], start):
            c, dt = col(name), fields[name]
            aggs.append(F.sum(F.when(_is_null(c, dt), 1).otherwise(0)).cast("long").alias(f"n{i}"))
            if isinstance(dt, T.StringType):
                ok = c.isNotNull() & parse_numeric(c, dt).isNotNull()
                aggs.append(F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias(f"k{i}"))
            if distinct != "exact":
                aggs.append(F.approx_count_distinct(F.when(~_is_null(c, dt), c), 0.05).cast("long").alias(f"d{i}"))
            elif isinstance(dt, integral):
                aggs += [F.min(c).cast("long").alias(f"l{i}"), F.max(c).cast("long").alias(f"h{i}")]
        wide.update(df.agg(*aggs).collect()[0].asDict())  # one row of per-column scalars
    rows = int(wide["rows"])
    absent = {i: int(wide[f"n{i}"] or 0) for i in range(len(columns))}
    if distinct == "exact":
        ranges = {i: (wide[f"l{i}"], wide[f"h{i}"], rows - absent[i]) for i in range(len(columns)) if wide.get(f"l{i}") is not None}
        unique = distinct_counts(df, list(range(len(columns))), columns, ranges)
    else:
        unique = {i: int(wide[f"d{i}"]) for i in range(len(columns))}
    out = []
    for i, name in enumerate(columns):
        k = wide.get(f"k{i}", 0 if isinstance(fields[name], T.StringType) else None)
        out.append((i, name, rows, absent[i], rows - absent[i], None if k is None else int(k), int(unique[i]), distinct == "exact"))
    return df.sparkSession.createDataFrame(out, "ordinal int, column string, rows long, null_count long, present_count long, "
                                               "numeric_count long, unique_count long, unique_exact boolean")


def sample_values(df: DataFrame, columns: list[str], order_col: str | None = None, k: int = 3) -> DataFrame:
    """First ``k`` present values per column in ONE pass: cells are
    exploded once and ``row_number() <= k`` per column becomes a partial
    window-group limit before the shuffle, so a column never ships more
    than k rows per partition."""
    from pyspark.sql import Window
    order = col(order_col) if order_col else F.monotonically_increasing_id()
    cells = df.select(order.alias("__o"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), col(n).cast("string").alias("value")) for i, n in enumerate(columns)
    ])).alias("c")).select("__o", "c.ordinal", "c.value").where(F.col("value").isNotNull())
    w = Window.partitionBy("ordinal").orderBy("__o")
    first = cells.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return first.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("__r", "value"))).alias("s")) \
        .select("ordinal", F.col("s.value").alias("sample_values"))


def decide_role(name: str, dtype: T.DataType, stats: dict, mapping: dict[str, str]) -> tuple[str, str]:
    """The strict rule order of role inference."""
    flags = N.name_flags(name)
    mapped = N.mapped_role((mapping or {}).get(name))
    present = stats["present_count"]
    if present == 0:
        return "unknown", "unknown"
    if mapped == "date":
        return "date", "date"
    if mapped == "dimension":
        return "category", "dimension"
    if mapped == "identifier":
        return "text", "identifier"
    if mapped == "measure":
        return "number", "measure"
    if is_temporal_type(dtype) or flags["date"]:
        return "date", "date"
    if flags["identifier"]:
        return "text", "identifier"
    if flags["time_dimension"] or flags["dimension"]:
        return "category", "dimension"
    if is_numeric_type(dtype):
        numeric_like = True
    elif isinstance(dtype, T.StringType):
        numeric_like = stats["numeric_count"] / present >= V.NUMERIC_LIKE_THRESHOLD
    else:
        numeric_like = False
    if flags["measure"] or numeric_like:
        return "number", "measure"
    if stats["unique_count"] <= max(V.CATEGORY_DISTINCT_FLOOR, stats["rows"] * V.CATEGORY_DISTINCT_SHARE):
        return "category", "unknown"
    return "text", "unknown"


def infer_columns(df: DataFrame, mapping: dict[str, str] | None = None, distinct: str = "exact",
                  samples: bool = False, order_col: str | None = None) -> list[ColumnProfile]:
    """Role inference.  Collects only the per-column statistics rows."""
    mapping = mapping or {}
    columns = [c for c in df.columns if not c.startswith("__")]
    stats = {r["ordinal"]: r.asDict() for r in column_stats(df, columns, distinct).collect()}
    samp = {}
    if samples:
        samp = {r["ordinal"]: list(r["sample_values"]) for r in sample_values(df, columns, order_col).collect()}
    out = []
    for i, name in enumerate(columns):
        s = stats[i]
        inferred, role = decide_role(name, df.schema[name].dataType, s, mapping)
        empty = s["present_count"] == 0
        ambiguous = role == "unknown" and name not in mapping and not empty
        reason = ("column is entirely empty and is left out of the working copy" if empty else
                  "name matched no term of the role dictionary" if ambiguous else
                  "inferred from the name and the value types")
        out.append(ColumnProfile(name, inferred, role, int(s["null_count"]), int(s["unique_count"] or 0),
                                 samp.get(i, []), ambiguous, reason, bool(s["unique_exact"])))
    return out


def profile_frame(spark: SparkSession, profiles: list[ColumnProfile]) -> DataFrame:
    """Profiles as a DataFrame (one row per column)."""
    rows = [(i, p.name, p.inferred_type, p.semantic_role, p.null_count, p.unique_count,
             [None if v is None else str(v) for v in p.sample_values], p.ambiguous, p.reason, p.unique_exact)
            for i, p in enumerate(profiles)]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def safe_metadata(profile_df: DataFrame) -> DataFrame:
    """Metadata export without sample values."""
    return profile_df.drop("sample_values")


def ambiguities(profile_df: DataFrame) -> DataFrame:
    """Columns needing a role decision from the user."""
    return profile_df.where(F.col("ambiguous")).select("ordinal", "name", "inferred_type", "reason")


def roles(profiles: list[ColumnProfile], role: str) -> list[str]:
    return [p.name for p in profiles if p.semantic_role == role]


def as_dicts(profiles: list[ColumnProfile]) -> list[dict]:
    return [asdict(p) for p in profiles]


def date_formats(df: DataFrame, columns: list[str], src: str = "__source_row") -> DataFrame:
    """P5: one row per text column: ``column, first_value`` (its cell of the
    smallest source row that is not null), ``format`` (the first of
    COLUMN_DATE_FORMATS that reads this cell; null: none does, the column is
    read cell by cell), ``texts`` (cells that are not null), ``fitting`` (cells
    that the format reads) and ``scores`` (how many cells each format reads).
    One aggregate over the columns; only its row is shaped further."""
    aggs = []
    for i, name in enumerate(columns):
        t = date_text(col(name))
        aggs += [F.min_by(t, F.when(t.isNotNull(), col(src))).alias(f"first{i}"), F.count(t).alias(f"texts{i}")]
        aggs += [F.count(parse_date_as(t, fmt)).alias(f"score{i}_{j}") for j, (fmt, _) in enumerate(COLUMN_DATE_FORMATS)]
    rows = []
    for i, name in enumerate(columns):
        first = F.col(f"first{i}")
        # texts of the same digits can fit two formats: the earlier one is the column's
        fmt = F.coalesce(*[F.when(parse_date_as(first, f).isNotNull(), F.lit(f)) for f, _ in COLUMN_DATE_FORMATS])
        scores = F.create_map(*[x for j, (f, _) in enumerate(COLUMN_DATE_FORMATS) for x in (F.lit(f), F.col(f"score{i}_{j}"))])
        rows.append(F.struct(F.lit(name).alias("column"), first.alias("first_value"), fmt.alias("format"), F.col(f"texts{i}").alias("texts"),
                             scores.alias("scores")))
    out = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("column", "first_value", "format", "texts", F.when(F.col("format").isNotNull(), F.element_at("scores", F.col("format"))).alias("fitting"), "scores")
