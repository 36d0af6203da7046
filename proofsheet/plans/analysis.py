"""R1–R3 and the end-to-end analysis job.

``analyze`` returns lazy DataFrames; the driver only holds metadata (column
roles, the plan) and a handful of one-row aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.functions import names as N
from proofsheet.functions import vocab as V
from proofsheet.functions.expr import col, day_label, is_temporal_type, period_label
from proofsheet.operators import insights as I
from proofsheet.operators import metrics as M
from proofsheet.operators import quality as Q
from proofsheet.operators.clean import CleanResult, clean_dataset
from proofsheet.operators.positions import with_file_row_index, with_row_index
from proofsheet.operators.profile import ColumnProfile, infer_columns, profile_frame
from proofsheet.operators.rollup import RollUp, roll_up, selection_set
from proofsheet.operators.verify import missing_refs, unproven_numbers
from proofsheet.session import saved

#: Key of the roll-up that holds the month of the first date.
MONTH = "__month"


@dataclass
class AnalysisPlan:
    """Which measures / dimensions / dates to use and the chart order."""
    measures: list[str]
    dimensions: list[str]
    dates: list[str]
    chart_strategy: list[str] = field(default_factory=list)


def default_plan(profiles: list[ColumnProfile]) -> AnalysisPlan:
    return AnalysisPlan([p.name for p in profiles if p.semantic_role == "measure"],
                        [p.name for p in profiles if p.semantic_role == "dimension"],
                        [p.name for p in profiles if p.semantic_role == "date"],
                        ["trend", "category_comparison", "share", "distribution"])


def normalize_plan(plan: AnalysisPlan, profiles: list[ColumnProfile]) -> AnalysisPlan:
    """Names not in the profile are rejected; known names move to the
    bucket of their profiled role."""
    known = {p.name: p.semantic_role for p in profiles}
    supplied = plan.measures + plan.dimensions + plan.dates
    unknown = [n for n in supplied if n not in known]
    if unknown:
        raise ValueError(f"unknown plan columns: {unknown}")
    ordered = list(dict.fromkeys(supplied))
    return AnalysisPlan([n for n in ordered if known[n] == "measure"], [n for n in ordered if known[n] == "dimension"],
                        [n for n in ordered if known[n] == "date"], plan.chart_strategy)


@dataclass
class AnalysisResult:
    profile: DataFrame
    clean: CleanResult
    quality: DataFrame
    results: DataFrame
    kpis: DataFrame
    charts: DataFrame
    insights: DataFrame
    filters: DataFrame
    table: DataFrame
    integrity: DataFrame
    currency: str
    plan: AnalysisPlan
    notes: DataFrame | None = None      # audit summary first, then the quality notes
    warnings: DataFrame | None = None   # the notes again when the score is below 90
    facts: DataFrame | None = None      # what the insights are made of
    rollup: RollUp | None = None        # charts, filters and selections without the rows


def with_source_row(df: DataFrame, source_row: str | None = None) -> DataFrame:
    """``df`` with ``__source_row``: a unique column of its own, else the row's
    number (W1) in its file or table."""
    if source_row:
        return df.withColumn("__source_row", col(source_row).cast("long"))
    if "__source_row" in df.columns:
        return df
    return with_file_row_index(df) if "__source_file" in df.columns else with_row_index(df, "__source_row", 2)


def _point_ref(prefix: str, index: str):
    return F.concat(F.lit(prefix), F.col(index).cast("string")).alias("result_ref")


def analyze(df: DataFrame | None, mapping: dict[str, str] | None = None, mode: str = "recommended",
            overrides: DataFrame | None = None, deleted_rows=None, plan: AnalysisPlan | None = None,
            source_row: str | None = None, quantiles: str = "exact", cleaned: CleanResult | None = None) -> AnalysisResult:
    """R2: profile → clean → quality → plan → metrics → insights → checks.
    With ``cleaned`` (``store.cleaned_copy``) nothing is cleaned; ``df``,
    ``overrides``, ``deleted_rows``, ``mode`` and ``source_row`` are not read."""
    if cleaned is None:
        df = with_source_row(df, source_row)
        profiles = infer_columns(df, mapping)
        cleaned = clean_dataset(df, profiles, mode, overrides, deleted_rows, quantiles=quantiles)
    work = cleaned.cleaned
    # roles are re-inferred on the typed working copy (a text date column is
    # now a timestamp, parsed money is now a number); mapped roles persist
    prof = infer_columns(work, mapping)
    plan = normalize_plan(plan, prof) if plan else default_plan(prof)
    measures = N.ordered_names([p.name for p in prof if p.semantic_role == "measure"], plan.measures)
    dims = N.ordered_names([p.name for p in prof if p.semantic_role == "dimension"], plan.dimensions)
    dates = N.ordered_names([p.name for p in prof if p.semantic_role == "date"], plan.dates)
    # ONE pass over the working copy for every global number: quality
    # counts, KPIs and the range of the first measure
    k_aggs, k_entries, kpis = M.kpi_aggs(measures)
    r_aggs = M.range_aggs(measures[0]) if measures else []
    glob = work.agg(*Q.quality_aggs(work, prof), *k_aggs, *r_aggs).collect()[0].asDict()
    quality = Q.quality_report(work, prof, quantiles, base=glob)

    qrow = quality.collect()[0]
    spark = work.sparkSession
    q_results = spark.createDataFrame([
        ("quality.score", float(qrow["score"]), "quality_profile", [], "quality_report"),
        ("quality.missing", float(qrow["missing_cells"]), "missing_count", [], "quality_report"),
        ("quality.duplicates", float(qrow["duplicate_rows"]), "duplicate_count", [], "quality_report"),
        ("quality.invalid", float(qrow["invalid_values"]), "invalid_count", [], "quality_report"),
        ("quality.outliers", float(qrow["outlier_count"]), "outlier_count", [], "quality_report"),
        ("quality.completeness", round((1 - float(qrow["missing_rate"])) * 100, 2), "completeness_rate", [],
         "(1 - missing_rate) * 100"),
    ], M.RESULTS_SCHEMA)
    spark_ = work.sparkSession
    kpi_rows = M.registry_rows(M.one_row(spark_, glob, [e[0] for e in k_entries]), k_entries)
    parts = [kpi_rows, q_results]
    charts, facts = [], []
    chart_measures = measures[:2]
    category_dim = next((d for d in dims if not N.is_temporal_dimension(d)), None)
    temporal = [d for d in dims if N.is_temporal_dimension(d)]
    time_keys = [MONTH] if dates else temporal[:2]
    # ONE more pass for all charts, filter values and later selections
    uniques = {p.name: p.unique_count for p in prof if p.name in dims and p.unique_exact}
    wanted = [[category_dim] if category_dim else [], time_keys, *[[d] for d in dims[:V.MAX_FILTERS]], selection_set(uniques)]
    wanted = [s for s in wanted if s]
    rollup = roll_up(work, wanted, measures, {MONTH: period_label(col(dates[0]))} if dates else None) if wanted else None
    if category_dim and chart_measures:
        top = saved(rollup.category_topk(category_dim, chart_measures))
        ops = [f"group_{N.primary_aggregate(m)}" for m in chart_measures]
        parts.append(M.chart_registry(top, "chart.category", [f"value_{i}" for i in range(len(chart_measures))], ops,
                                      [[category_dim, m] for m in chart_measures], "rank"))
        parts.append(I.category_readings(top, category_dim, chart_measures[0]))
        facts.append(I.category_facts(top, chart_measures))
        for i, m in enumerate(chart_measures):
            charts.append(top.select(F.lit("category-bar").alias("chart_id"), F.col("rank").alias("ordinal"),
                                     F.col("category").alias("label"), F.col(f"value_{i}").alias("value"), F.lit(m).alias("series"),
                                     _point_ref(f"chart.category.{i}.", "rank")))
        charts.append(top.where(F.col("rank") < V.DONUT_TOP_K).select(
            F.lit("category-donut").alias("chart_id"), F.col("rank").alias("ordinal"),
            F.col("category").alias("label"), F.col("value_0").alias("value"), F.lit(chart_measures[0]).alias("series"),
            _point_ref("chart.category.0.", "rank")))
    if chart_measures and time_keys:
        tcols = dates[:1] if dates else temporal[:2]
        tr = saved(rollup.trend(time_keys, chart_measures))
        ops = [f"period_{N.primary_aggregate(m)}" for m in chart_measures]
        parts.append(M.chart_registry(tr, "chart.trend", [f"value_{i}" for i in range(len(chart_measures))], ops,
                                      [[*tcols, m] for m in chart_measures], "ordinal"))
        parts.append(I.trend_readings(tr, tcols[0], chart_measures[0]))
        facts.append(I.trend_facts(tr, chart_measures[0]))
        for i, m in enumerate(chart_measures):
            charts.append(tr.select(F.lit("time-line").alias("chart_id"), "ordinal", F.col("period").alias("label"),
                                    F.col(f"value_{i}").alias("value"), F.lit(m).alias("series"), _point_ref(f"chart.trend.{i}.", "ordinal")))
    if measures:
        m0 = measures[0]
        rng = M.one_row(spark_, glob, ["min_value", "avg_value", "max_value"])
        parts.append(M.registry_rows(rng, [("min_value", f"dist.{m0}.min", "min", [m0], "min"),
                                           ("avg_value", f"dist.{m0}.avg", "average", [m0], "avg"),
                                           ("max_value", f"dist.{m0}.max", "max", [m0], "max")]))
        parts.append(I.range_readings(rng, m0))
        facts.append(I.range_facts(rng, m0))
        charts.append(rng.select(F.explode(F.array(
            F.struct(F.lit(0).alias("ordinal"), F.lit("min").alias("label"), F.col("min_value").alias("value"), F.lit(f"dist.{m0}.min").alias("ref")),
            F.struct(F.lit(1).alias("ordinal"), F.lit("average").alias("label"), F.col("avg_value").alias("value"), F.lit(f"dist.{m0}.avg").alias("ref")),
            F.struct(F.lit(2).alias("ordinal"), F.lit("max").alias("label"), F.col("max_value").alias("value"), F.lit(f"dist.{m0}.max").alias("ref")),
        )).alias("p")).select(F.lit("distribution").alias("chart_id"), "p.ordinal", "p.label", "p.value", F.lit(m0).alias("series"),
                              F.col("p.ref").alias("result_ref")))
    if not charts:
        charts.append(q_results.where(F.col("key").isin("quality.score", "quality.missing", "quality.duplicates"))
                      .select(F.lit("quality-overview").alias("chart_id"), F.lit(0).alias("ordinal"),
                              F.col("key").alias("label"), "value", F.lit(None).cast("string").alias("series"), F.col("key").alias("result_ref")))
    results = parts[0]
    for p in parts[1:]:
        results = results.unionByName(p)
    chart_df = charts[0]
    for c in charts[1:]:
        chart_df = chart_df.unionByName(c)
    # Chart order follows the plan's strategy, then the build order
    strategy_ids = {"trend": "time-line", "category_comparison": "category-bar", "share": "category-donut",
                    "distribution": "distribution"}
    desired = [strategy_ids[x] for x in plan.chart_strategy if x in strategy_ids]
    built = ["category-bar", "category-donut", "time-line", "distribution", "quality-overview"]
    rank = {cid: (desired.index(cid) if cid in desired else len(desired) + built.index(cid)) for cid in built}
    order_expr = F.lit(99)
    for cid, r in rank.items():
        order_expr = F.when(F.col("chart_id") == cid, F.lit(r)).otherwise(order_expr)
    chart_df = chart_df.withColumn("chart_order", order_expr)
    results = saved(results)   # some tens of rows, read by every check below
    kpi_df = spark.createDataFrame([(k.id, k.label, k.key, k.format, k.operation) for k in kpis],
                                   "id string, label string, result_ref string, format string, operation string")
    kpi_order = spark.createDataFrame([(i, k.label, k.key) for i, k in enumerate(kpis)], "ordinal int, label string, result_ref string")
    points = chart_df.withColumn("ordinal", (F.col("chart_order") * 1000 + F.col("ordinal")).cast("int"))
    all_facts = I.scope_facts(results).unionByName(I.reading_facts(kpi_order, points, results))
    for f in facts:
        all_facts = all_facts.unionByName(f)
    insights = saved(I.complete_insights(all_facts)).orderBy("ordinal")
    filters = None
    for d in dims[:V.MAX_FILTERS]:
        first_seen = rollup.first_values(d)
        filters = first_seen if filters is None else filters.unionByName(first_seen)
    if filters is None:
        filters = spark.createDataFrame([], "column string, value string, __first long")
    table = work.select("__source_row", *[day_label(col(f.name)).alias(f.name) if is_temporal_type(f.dataType) else col(f.name)
                                           for f in work.schema.fields if not f.name.startswith("__")])
    integrity = missing_refs(insights.select("result_refs"), results).unionByName(
        missing_refs(kpi_df.select(F.col("result_ref").alias("ref")), results)).unionByName(
        missing_refs(chart_df.select(F.col("result_ref").alias("ref")), results)).unionByName(
        unproven_numbers(insights, results).select(F.concat(F.lit("number:"), F.col("raw")).alias("ref")))
    summary = cleaned.summary().select(F.lit(-1).alias("ordinal"), F.col("summary").alias("note"))
    notes = summary.unionByName(Q.quality_notes(quality)).orderBy("ordinal")
    warnings = notes if qrow["score"] < V.DASHBOARD_WARNING_SCORE else notes.where(F.lit(False))
    return AnalysisResult(profile_frame(spark, prof), cleaned, quality, results, kpi_df, chart_df, insights,
                          filters, table, integrity, N.currency_code(measures), plan, notes, warnings, all_facts, rollup)
