"""One scan for charts, filters and selections."""

import pytest
from pyspark.sql import functions as F

from proofsheet.functions.expr import period_label
from proofsheet.operators import explore as X
from proofsheet.operators import metrics as M
from proofsheet.operators.rollup import grouping_id, roll_up, selection_set
from proofsheet.sources.tables import load_table
from tests.conftest import SF


@pytest.fixture(scope="module")
def orders(spark):
    return load_table(spark, SF, "orders").withColumn("__source_row", F.col("o_orderkey"))


@pytest.fixture(scope="module")
def cube(orders):
    return roll_up(orders, [["o_orderstatus"], ["m"], ["o_orderstatus", "o_orderpriority"]], ["o_totalprice", "o_custkey"],
                   {"m": period_label(F.col("o_orderdate"))})


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_charts_equal_those_of_the_rows(orders, cube):
    ms = ["o_totalprice", "o_custkey"]
    assert rows(cube.category_topk("o_orderstatus", ms)) == rows(M.category_topk(orders, "o_orderstatus", ms))
    assert rows(cube.trend(["m"], ms)) == rows(M.trend(orders, ["o_orderdate"], ms, is_date=True))
    want = (orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("f")).orderBy("f"))
    assert [(r["value"], r["__first"]) for r in cube.first_values("o_orderpriority").collect()] == rows(want)


@pytest.mark.parametrize("chart", ["bar", "line", "donut"])
def test_selections_equal_those_of_the_rows(orders, cube, chart):
    sel = {"o_orderstatus": "F", "o_orderpriority": ""}
    chosen = X.equality_filters(orders, sel)
    assert rows(cube.explore("o_orderpriority", "o_totalprice", chart, sel)) == rows(X.explore(chosen, "o_orderpriority", "o_totalprice", chart))
    assert rows(cube.selection_range("o_totalprice", sel)) == rows(X.selection_range(orders, "o_totalprice", sel))
    for op in ("sum", "average", "min", "max", "count"):
        assert rows(cube.kpi(op, "o_totalprice", sel)) == rows(X.kpi_under_selection(orders, op, "o_totalprice", sel))


def test_null_groups_and_empty_tables(spark):
    data = [("a", None, 1.25), (None, "x", 2.0), ("a", "x", None), (None, None, 4.5), ("a", "x", 3.0), ("", "x", 9.0)]
    df = spark.createDataFrame(data, "a string, b string, `__v 1` double").withColumnRenamed("__v 1", "v 1.0")
    cube = roll_up(df, [["a", "b"], ["a"], ["a"]], ["v 1.0"])
    assert cube.sets == (("a", "b"), ("a",))
    assert rows(cube.kpi("count")) == [(6.0,)] and rows(cube.kpi("sum", "v 1.0")) == [(19.75,)]
    assert rows(cube.explore("a", "v 1.0")) == [("a", 4.25)]
    assert rows(cube.explore("b", "v 1.0", filters={"a": "a"})) == [("x", 3.0)]
    assert [r["__first"] for r in cube.first_values("a").collect()] == [None, None]
    with pytest.raises(KeyError):
        cube.states("a", "c")
    none = roll_up(df.where("false"), [["a"]], ["v 1.0"])
    assert none.category_topk("a", ["v 1.0"]).count() == 0 and rows(none.kpi("count")) == [(0.0,)]


def test_selection_set_is_bounded_by_distinct_counts():
    assert selection_set({"a": 9, "b": 99, "c": 3}, 4000) == ["c", "a", "b"]
    assert selection_set({"a": 9, "b": 99, "c": 3}, 3999) == ["c", "a"]
    assert grouping_id(("a", "b", "c"), ("a", "c")) == 2


def test_analyze_reads_the_rows_once_for_all_charts(spark):
    from proofsheet.plans.analysis import analyze
    from proofsheet.queries import ORDERS_MAPPING
    res = analyze(load_table(spark, SF, "orders"), ORDERS_MAPPING, source_row="o_orderkey")
    for frame in (res.charts, res.filters, res.insights, res.integrity, res.results):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "Scan" in line]
        assert not [x for x in scans if "Scan ExistingRDD" in x and "o_totalprice#" in x]   # the checkpointed working copy
        assert not [x for x in scans if "orders.parquet" in x]
    assert res.rollup.covers("o_orderstatus", "o_orderpriority")
