"""Quality profile.

One wide aggregate for missing / invalid / formula-like cells, one grouped
count for duplicate rows, and one exact-quantile pass over all measures at
once (measures are unpivoted to ``(measure, value)`` so a single range sort
serves every fence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions import vocab as V
from proofsheet.functions.expr import col, parse_date, parse_numeric
from proofsheet.operators.fingerprints import repeats
from proofsheet.operators.positions import exact_quantiles, join_small
from proofsheet.operators.profile import ColumnProfile


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def duplicate_row_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row over all columns (null = null)."""
    return repeats(df, columns or _data_columns(df))


def measure_values(df: DataFrame, measures: list[str]) -> DataFrame:
    """Unpivot typed measure values to long ``(measure, value)``."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), parse_numeric(col(m), fields[m]).alias("value")) for m in measures])
    return df.select(F.explode(cells).alias("c")).select("c.measure", "c.value").where(F.col("value").isNotNull())


def iqr_outliers(df: DataFrame, value: str, groups: list[str] | None = None,
                 quantiles: str = "exact", max_groups: int | None = None,
                 max_values: int | None = None) -> DataFrame:
    """Per group, n ≥ 4 and IQR > 0 → count of values outside
    ``[q1 − 1.5·IQR, q3 + 1.5·IQR]`` (linear-interpolated quartiles)."""
    groups = list(groups or [])
    vals = df.select(*[col(g) for g in groups], col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    if quantiles == "approx":
        fences = vals.groupBy(*groups).agg(F.percentile_approx("__v", [0.25, 0.75], 10000).alias("qs"),
                                          F.count(F.lit(1)).alias("n")) \
            .select(*groups, "n", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("q3"))
    else:
        qs = exact_quantiles(vals, "__v", [0.25, 0.75], groups, size_hint=max_values)
        counts = vals.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
        fences = qs.groupBy(*groups).agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
                                         F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
        fences = fences.join(counts, groups, "inner") if groups else _attach(fences, counts)
    fences = fences.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lo", F.col("q1") - V.OUTLIER_IQR_FACTOR * F.col("iqr")) \
        .withColumn("hi", F.col("q3") + V.OUTLIER_IQR_FACTOR * F.col("iqr"))
    active = fences.where((F.col("n") >= 4) & (F.col("iqr") > 0))
    if groups:
        flagged = join_small(vals, active.select(*groups, "lo", "hi"), groups, "inner", known_rows=max_groups)
    else:
        r = active.select("lo", "hi").collect()
        if not r:
            return df.sparkSession.createDataFrame([(0,)], "outliers long")
        flagged = vals.withColumn("lo", F.lit(r[0]["lo"])).withColumn("hi", F.lit(r[0]["hi"]))
    out = flagged.groupBy(*groups).agg(F.count_if((F.col("__v") < F.col("lo")) | (F.col("__v") > F.col("hi"))).cast("long").alias("outliers"))
    if not groups:
        out = out.select(F.coalesce(F.col("outliers"), F.lit(0)).alias("outliers"))
    return out


def _attach(fences: DataFrame, counts: DataFrame) -> DataFrame:
    """Global (ungrouped) case: both sides are one row."""
    n = counts.collect()
    return fences.withColumn("n", F.lit(n[0]["n"] if n else 0))


def quality_aggs(df: DataFrame, profiles: list[ColumnProfile]) -> list:
    """The global aggregates of the report (row, missing, invalid and
    formula-like counts) as Columns, so a caller can fold them into one
    aggregate with other global metrics of the same table."""
    cols = _data_columns(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    roles = {p.name: p.semantic_role for p in profiles}
    aggs = [F.count(F.lit(1)).alias("row_count")]
    miss, invalid, formula = [], [], []
    for i, c in enumerate(cols):
        dt = fields[c]
        isnull = col(c).isNull() | F.isnan(col(c)) if isinstance(dt, (T.FloatType, T.DoubleType)) else col(c).isNull()
        miss.append(F.count_if(isnull))
        if isinstance(dt, T.StringType):
            formula.append(F.count_if(col(c).rlike("^[=+\\-@]")))
        if roles.get(c) == "measure":
            invalid.append(F.count_if(col(c).isNotNull() & parse_numeric(col(c), dt).isNull()))
        elif roles.get(c) == "date":
            invalid.append(F.count_if(col(c).isNotNull() & parse_date(col(c), dt).isNull()))
    total = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0)
    aggs += [total(miss).cast("long").alias("missing_cells"), total(invalid).cast("long").alias("invalid_values"),
             total(formula).cast("long").alias("formula_like_cells")]
    return aggs


QUALITY_BASE = ("row_count", "missing_cells", "invalid_values", "formula_like_cells")


def quality_report(df: DataFrame, profiles: list[ColumnProfile], quantiles: str = "exact",
                   base: dict | None = None) -> DataFrame:
    """One-row quality report.  ``base``: the values of
    ``quality_aggs`` when the caller already computed them."""
    cols = _data_columns(df)
    roles = {p.name: p.semantic_role for p in profiles}
    if base is None:
        base = df.agg(*quality_aggs(df, profiles)).collect()[0].asDict()  # one row of scalars
    base = {k: base[k] for k in QUALITY_BASE}
    dups = duplicate_row_count(df, cols).collect()[0].asDict()
    measures = [c for c in cols if roles.get(c) == "measure"]
    outl = {"outlier_count": 0}
    if measures:
        out = iqr_outliers(measure_values(df, measures), "value", ["measure"], quantiles,
                           max_groups=len(measures), max_values=base["row_count"] * len(measures))
        outl = out.agg(F.coalesce(F.sum("outliers"), F.lit(0)).cast("long").alias("outlier_count")).collect()[0].asDict()
    one = df.sparkSession.createDataFrame([{**base, **dups, **outl}],
                                          "row_count long, missing_cells long, invalid_values long, "
                                          "formula_like_cells long, duplicate_rows long, outlier_count long")
    ncols = len(cols)
    cells = F.greatest(F.col("row_count") * F.lit(ncols), F.lit(1))
    rate = F.col("missing_cells") / cells
    dup_rate = F.col("duplicate_rows") / F.greatest(F.col("row_count"), F.lit(1))
    penalty = F.least(F.lit(100.0), F.bround(rate * 55 + dup_rate * 20 + F.col("invalid_values") * 2 + F.col("outlier_count"), 0))
    norm_penalty = F.least(F.lit(100.0), F.bround(rate * 55 + dup_rate * 20
                                                  + F.col("invalid_values") / cells * 200 + F.col("outlier_count") / cells * 100, 0))
    return one.select(
        "row_count", F.lit(ncols).cast("long").alias("column_count"), "missing_cells",
        F.round(rate, V.RATE_DP).alias("missing_rate"), "duplicate_rows", "invalid_values", "outlier_count",
        "formula_like_cells",
        F.greatest(F.lit(0), F.lit(100) - penalty).cast("long").alias("score"),
        F.greatest(F.lit(0), F.lit(100) - norm_penalty).cast("long").alias("score_normalized"),
    )


def quality_notes(report: DataFrame) -> DataFrame:
    """One note per non-zero counter (or a single all-clear note)."""
    notes = F.array(
        F.when(F.col("missing_cells") > 0, F.format_string("%d missing cells found.", "missing_cells")),
        F.when(F.col("duplicate_rows") > 0, F.format_string("%d duplicate rows found.", "duplicate_rows")),
        F.when(F.col("invalid_values") > 0, F.format_string("%d values do not match the expected type.", "invalid_values")),
        F.when(F.col("outlier_count") > 0, F.format_string("%d statistical outliers found.", "outlier_count")),
        F.when(F.col("formula_like_cells") > 0, F.format_string("%d formula-like text values neutralised for display.", "formula_like_cells")),
    )
    kept = F.filter(notes, lambda x: x.isNotNull())
    final = F.when(F.size(kept) == 0, F.array(F.lit("No material data-quality issues found."))).otherwise(kept)
    return report.select(F.posexplode(final).alias("ordinal", "note"))


def completeness(report: DataFrame) -> DataFrame:
    """Completeness % = (1 − missing_rate) · 100, 2 dp."""
    return report.select(F.round((1 - F.col("missing_rate")) * 100, V.RESULT_DP).alias("completeness"))


def quality_readings(report: DataFrame) -> DataFrame:
    """The quality readings with their registry keys."""
    comp = F.round((1 - F.col("missing_rate")) * 100, V.RESULT_DP)
    rows = F.array(
        F.struct(F.lit("rows.total").alias("key"), F.col("row_count").cast("double").alias("value")),
        F.struct(F.lit("quality.score").alias("key"), F.col("score").cast("double").alias("value")),
        F.struct(F.lit("quality.missing").alias("key"), F.col("missing_cells").cast("double").alias("value")),
        F.struct(F.lit("quality.duplicates").alias("key"), F.col("duplicate_rows").cast("double").alias("value")),
        F.struct(F.lit("quality.completeness").alias("key"), comp.cast("double").alias("value")),
        F.struct(F.lit("quality.invalid").alias("key"), F.col("invalid_values").cast("double").alias("value")),
        F.struct(F.lit("quality.outliers").alias("key"), F.col("outlier_count").cast("double").alias("value")),
    )
    return report.select(F.explode(rows).alias("r")).select("r.key", "r.value")
