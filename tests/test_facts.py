"""Facts and their words."""

from pyspark.sql import functions as F

from proofsheet.operators import insights as I
from proofsheet.operators import verify as VF


def facts_of(df):
    return {r["verb"]: r for r in df.collect()}


def test_category_facts_ties_nulls_and_one_category(spark):
    top = spark.createDataFrame([(0, "b", 9.0, 2.0), (1, "c", 4.0, 7.0), (2, "d", None, 7.0)], "rank int, category string, value_0 double, value_1 double")
    f = facts_of(I.category_facts(top, ["m", "w"]))
    assert (f["leads"].subject, f["follows"].subject, f["trails"].subject) == ("b", "c", "d")
    assert f["lead margin"].numbers == [5.0] and f["gap"].numbers == [9.0] and f["gap"].refs[2] == "chart.category.0.2"
    assert f["share"].numbers == [69.23]
    assert (f["second highest"].subject, f["second lowest"].subject) == ("c", "b")      # a tie: the first shown
    assert f["second highest"].refs == ["chart.category.1.1"]
    assert set(facts_of(I.category_facts(top.where("rank = 0"), ["m"]))) == {"leads", "share"}
    assert facts_of(I.category_facts(top.where("false"), ["m"])) == {}


def test_trend_facts(spark):
    tr = spark.createDataFrame([(0, "2020-01", 2.0), (1, "2020-02", 6.0), (2, "2020-03", 6.0), (3, "2020-04", 2.0)], "ordinal int, period string, value_0 double")
    f = facts_of(I.trend_facts(tr, "m"))
    assert (f["peak"].subject, f["weakest"].subject) == ("2020-02", "2020-01")
    assert f["change"].numbers == [0.0] and f["average"].numbers == [4.0] and f["above average"].numbers == [2.0]
    assert f["distance from peak"].refs == ["trend.primary.distance_from_peak", "chart.trend.0.1", "chart.trend.0.3"]
    assert "change rate" not in facts_of(I.trend_facts(tr.withColumn("value_0", F.col("value_0") - 2), "m"))
    assert facts_of(I.trend_facts(tr.where("false"), "m")) == {}


def test_words_keep_names_that_look_like_placeholders(spark):
    top = spark.createDataFrame([(0, "{m} $1 {0}", 1234567.5), (1, "x", 1.0)], "rank int, category string, value_0 double")
    texts = {r["verb"]: r["text"] for r in I.render(I.category_facts(top, ["{s}"])).collect()}
    assert texts["leads"] == "«{m} $1 {0}» leads in «{s}» with 1234567.50."
    assert texts["follows"] == "«x» is second in «{s}» with 1."


def test_completion_order_titles_and_a_planted_fault(spark):
    top = spark.createDataFrame([(0, "b", 9.0), (1, "c", 4.0)], "rank int, category string, value_0 double")
    facts = I.category_facts(top, ["m"])
    done = I.complete_insights(facts.unionByName(facts), 4).orderBy("ordinal").collect()
    assert [r["title"] for r in done] == ["Category leader", "Category runner-up", "Margin of the category leader", "Lowest category shown"]
    results = spark.createDataFrame([("chart.category.0.0", 9.0), ("chart.category.0.1", 4.5), ("category.primary.lead_margin", 5.0)], "key string, value double")
    ins = I.complete_insights(facts, 4)
    assert {r["raw"] for r in VF.unproven_numbers(ins, results).collect()} == {"4"}
    assert VF.missing_refs(ins.select("result_refs"), results).count() == 0
