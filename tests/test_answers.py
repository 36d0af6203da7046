"""One call from a question to a verified answer: refusals, quality questions, planted faults."""

import pytest
from pyspark.sql import functions as F

from proofsheet.operators.profile import ColumnProfile
from proofsheet.operators.verify import VerificationError
from proofsheet.plans import answers as A
from proofsheet.plans import question as Q

PROFILES = [ColumnProfile("brand", "category", "dimension"), ColumnProfile("year", "category", "dimension"), ColumnProfile("revenue", "number", "measure")]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(f"Brand#{1 + i % 23}", 1999 + i % 3, 10.0 * (1 + i % 23) + i % 3, i) for i in range(690)] + [("Brand#30", 1999, 0.0, 900), ("Brand#30", 2000, 5.0, 901)]
    return Q.build_catalog(spark.createDataFrame(rows, "brand string, year int, revenue double, __source_row long"), PROFILES)


def ask(question, catalog):
    return A.answer(question, catalog).first()


def test_answers_and_refusals(catalog):
    assert ask("What is the total revenue of Brand#12 in 2000?", catalog)["answer"].startswith("sum of revenue (year=2000; brand=Brand#12): ")
    assert "; Brand#20 leads by" in ask("Compare revenue of Brand#2 and Brand#20", catalog)["answer"]
    assert ask("Top 3 brands by revenue 2000", catalog)["answer"].startswith("ranking of revenue by brand (year=2000): 1. Brand#23")
    assert ask("What is the total revenue of Brand#30 in 2001?", catalog)["error"] == "no rows match the question"
    assert ask("Revenue growth of Brand#2 in 2000", catalog)["error"] == "a growth needs two groups or more"
    assert ask("Revenue growth of Brand#30 by year", catalog)["error"] == "a growth rate needs a first period that is not zero"
    assert ask("What is the total revenue in 2035?", catalog)["error"] == "year 2035 is not in the data"
    refused = ask("What is the total revenue in 2035?", catalog)
    assert refused["answer"] is None and refused["sources"] is None


def test_growth_has_no_one_task_window(catalog):
    plan = Q.SafeQueryPlan("growth", "revenue", "sum", time_column="year")
    out = Q.run_plan(catalog.df, plan)
    plan_text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan_text and plan_text.count("Window [sum(__n") == plan_text.count("Window [")  # counts of partitions only
    assert [(r["ordinal"], r["label"]) for r in out.orderBy("ordinal").collect()] == [(0, "1999"), (1, "2000"), (2, "2001")]


def test_growth_puts_a_missing_period_last(spark, catalog):
    rows = spark.createDataFrame([(None, 1.0), (2001, 2.0), (1999, 3.0), (2001, 4.0)], "year int, revenue double")
    out = Q.run_plan(rows, Q.SafeQueryPlan("growth", "revenue", "sum", time_column="year")).orderBy("ordinal").collect()
    assert [(r["label"], r["value"], r["rows"]) for r in out] == [("1999", 3.0, 1), ("2001", 6.0, 2), (None, 1.0, 1)]


@pytest.mark.parametrize("fault", ["value", "dropped period", "wrong leader"])
def test_planted_faults_are_found(catalog, fault):
    question = "Top 3 brands by revenue 2000" if fault == "wrong leader" else "Revenue growth of Brand#2 by year"
    plan = Q.plan_question(question, catalog)
    good = Q.run_plan(catalog.df, plan)
    base = catalog.df.where(Q.in_filters(plan.filters))
    A.verify_result(plan, good, base)
    if fault == "value":
        bad = good.withColumn("value", F.when(F.col("ordinal") == 1, F.col("value") + 1).otherwise(F.col("value")))
    elif fault == "dropped period":
        bad = good.where("ordinal != 1")
    else:  # three right values, but not the three largest
        four = Q.run_plan(catalog.df, Q.SafeQueryPlan(plan.operation, plan.measure, plan.aggregation, plan.filters, plan.group_by, plan.order, 4))
        bad = four.where("ordinal > 0").withColumn("ordinal", F.col("ordinal") - 1)
    with pytest.raises(VerificationError):
        A.verify_result(plan, bad, base)


def test_quality_question_names_every_row(spark, catalog):
    from proofsheet.operators.clean import clean_dataset
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i), "x", f"note {i}") for i in range(1, 41)] + [(41, 2.0, None, "last")],
                               "__source_row long, amount double, kind string, note string")
    res = clean_dataset(df, [ColumnProfile("amount", "number", "measure"), ColumnProfile("kind", "category", "dimension"),
                             ColumnProfile("note", "category", "dimension")])
    text = A.answer("Which values were missing?", catalog, clean=res).first()
    assert text["answer"].startswith("9 missing cells were found: amount (8), kind (1).") and text["answer"].endswith("None remains untreated.")
    lists = A.quality_rows(res.actions, block=16).collect()
    assert sorted(r for x in lists if x["column"] == "amount" for r in x["rows"]) == list(range(5, 41, 5))
    assert all(len(x["rows"]) <= 16 and x["cells"] == len(x["rows"]) and x["first_row"] == x["rows"][0] for x in lists)
    whole = clean_dataset(df.where("amount is not null and kind is not null"), res.profiles)
    assert A.answer("Which values were missing?", catalog, clean=whole).first()["answer"] == "No missing cells were found in the data rows. None remains untreated."
