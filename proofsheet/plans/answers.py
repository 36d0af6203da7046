"""From a question to a verified answer in one call.

A question about missing or cleaned values is answered from the cleaning
audit; any other is planned, run, recomputed on a second path and put into
words.  The recomputation covers what the plan claims: each value, for a growth
each period, and for a limited ranking that no group outside it belongs in it.
Results hold at most 20 rows, or one row per period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.functions import vocab as V
from proofsheet.functions.expr import as_label, col, in_filters
from proofsheet.operators.clean import CleanResult
from proofsheet.operators.verify import assert_reconciled, isclose, reconcile, second_path
from proofsheet.plans.question import (Catalog, QuestionError, SafeQueryPlan, answer_text, growth_answer, is_quality_question,
                                       plan_question, run_plan)
from proofsheet.session import cut_lineage

SCHEMA = "question string, answer string, sources array<string>, error string"
QUALITY_SOURCES = ["missing-value audit", "imputation policy", "cleaned working copy"]
#: Source rows that one list of ``quality_rows`` names at most.
ROWS_BLOCK = 1000


def outside_better(plan: SafeQueryPlan, result: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups (``label``, ``__check``) missing from a limited ranking although they beat its last row."""
    last = result.agg(F.max_by("value", "ordinal"), F.count("*")).first()
    if last[1] < max(1, min(plan.limit, V.QUESTION_MAX_LIMIT)):  # no group was cut off: every one of them must be there
        better = F.lit(True)
    else:
        beats = F.col("__check") < F.lit(last[0]) if plan.order == "asc" else F.col("__check") > F.lit(last[0])
        better = beats & ~isclose(F.col("__check"), F.lit(last[0]))
    there = result.select(F.col("label").alias("__label"))
    return groups.join(F.broadcast(there), F.col("label").eqNullSafe(F.col("__label")), "left_anti").where(better)


def verify_result(plan: SafeQueryPlan, result: DataFrame, base: DataFrame) -> None:
    """J1 for a question: the plan's result against plain double aggregates of the filtered rows."""
    group = plan.time_column if plan.operation == "growth" else plan.group_by
    if plan.operation == "aggregate":
        assert_reconciled(reconcile(result, base, [], "value", plan.aggregation, plan.measure))
        return
    rows = base.select(as_label(col(group), base.schema[group].dataType).alias("label"), col(plan.measure).alias("__measure"))
    assert_reconciled(reconcile(result, rows, ["label"], "value", plan.aggregation, "__measure", complete=plan.operation == "growth"))
    if plan.operation != "growth":
        groups = rows.groupBy("label").agg(F.coalesce(second_path(plan.aggregation, F.col("__measure")), F.lit(0.0)).alias("__check"))
        assert_reconciled(outside_better(plan, result, groups))


def checked_rows(plan: SafeQueryPlan, df: DataFrame) -> DataFrame:
    """A plan's rows, verified; no rows, or too few to compare, refuse the question."""
    result = cut_lineage(run_plan(df, plan))
    n, rows = result.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if not rows:
        raise QuestionError("no rows match the question")
    if plan.operation in ("comparison", "growth") and n < 2:
        raise QuestionError(f"a {plan.operation} needs two groups or more")
    if plan.operation == "growth" and growth_answer(result).first()["growth_pct"] is None:
        raise QuestionError("a growth rate needs a first period that is not zero")
    verify_result(plan, result, df.where(in_filters(plan.filters)) if plan.filters else df)
    return result


def quality_rows(actions: DataFrame, block: int = ROWS_BLOCK) -> DataFrame:
    """Q10: every source row the audit names, by column and action: ``column,
    strategy, first_row, cells, rows``.  Each list holds the rows of one
    stretch of ``block`` row numbers, so that no list grows with the table."""
    lists = actions.groupBy("column", "strategy", F.floor(F.col("source_row") / block).alias("__block")).agg(
        F.min("source_row").alias("first_row"), F.count(F.lit(1)).alias("cells"), F.sort_array(F.collect_set("source_row")).alias("rows"))
    return lists.drop("__block")


def quality_text(clean: CleanResult) -> DataFrame:
    """Q10 in words, one row ``answer``: the missing cells by column, what was done with them, and what remains."""
    found = clean.missing_before.agg(
        F.sum("missing").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "missing"))),
                                                              lambda x: F.format_string("%s (%d)", x["column"], x["missing"])), ", ").alias("names"))
    head = F.when(F.coalesce("n", F.lit(0)) > 0, F.format_string("%d missing cells were found: %s.", F.col("n"), F.col("names"))).otherwise(
        F.lit("No missing cells were found in the data rows."))
    done = clean.actions.groupBy("column", "strategy").agg(F.count(F.lit(1)).alias("n"))
    left, out = F.col("remaining_missing_values"), F.col("excluded_summary_rows")
    tail = F.when(left > 0, F.format_string("%d remain for review.", left)).otherwise(F.lit("None remains untreated."))
    tail = F.when(out > 0, F.concat(tail, F.format_string(" %d summary rows were excluded.", out))).otherwise(tail)
    parts = (found.select(F.lit(0).alias("place"), head.alias("text"))
             .unionByName(done.select(F.lit(1).alias("place"), F.format_string("%s: %d by %s.", F.col("column"), F.col("n"), F.col("strategy")).alias("text")))
             .unionByName(clean.counters.select(F.lit(2).alias("place"), tail.alias("text"))))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("answer"))


def answer(question: str, catalog: Catalog, currency: str = "SAR", clean: CleanResult | None = None) -> DataFrame:
    """One row ``question, answer, sources, error``.  With ``clean``, questions
    about missing values are answered from its audit.  A question that cannot be
    planned, matches no rows, or has nothing to compare gets ``error`` instead of
    an answer; a result that the second path does not confirm raises
    ``VerificationError``."""
    named = F.lit(question).alias("question")
    if clean is not None and is_quality_question(question):
        return quality_text(clean).select(named, "answer", F.array(*map(F.lit, QUALITY_SOURCES)).alias("sources"), F.lit(None).cast("string").alias("error"))
    try:
        plan = plan_question(question, catalog)
        result = checked_rows(plan, catalog.df)
    except QuestionError as refused:
        return catalog.df.sparkSession.createDataFrame([(question, None, None, str(refused))], SCHEMA)
    group = plan.time_column if plan.operation == "growth" else plan.group_by
    sources = dict.fromkeys([plan.measure, *([group] if group else []), *[f.column for f in plan.filters]])
    return answer_text(plan, result, currency).select(
        named, "answer", F.array(*map(F.lit, sources)).alias("sources"), F.lit(None).cast("string").alias("error"))
