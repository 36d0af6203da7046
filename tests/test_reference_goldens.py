"""Golden expectations taken from the analysed application's own tests."""

import os
import tempfile

from pyspark.sql import functions as F

from proofsheet.operators.positions import with_row_index
from proofsheet.operators.profile import infer_columns
from proofsheet.plans.analysis import AnalysisPlan, analyze
from proofsheet.sources.workbook import read_sheet
from tests.xlsx_fixture import write_xlsx


def test_business_time_columns_are_dimensions(spark):
    df = spark.createDataFrame([("Jarir", 2022, "Q1", 1000, 0.2), ("SACO", 2023, "Q2", 1200, 0.3)],
                               "Company string, Year int, Quarter string, Total_Revenue long, Ecom_Percentage double")
    roles = {p.name: p.semantic_role for p in infer_columns(df)}
    assert roles == {"Company": "dimension", "Year": "dimension", "Quarter": "dimension",
                     "Total_Revenue": "measure", "Ecom_Percentage": "measure"}


def test_whitespace_cells_are_missing(spark):
    d = tempfile.mkdtemp(prefix="ps-xlsx-")
    write_xlsx(os.path.join(d, "spaces.xlsx"), [("Sheet1", [["Company", "Sales"], ["Jarir", 10], ["   ", 20], ["SACO", 30]])])
    df = read_sheet(spark, d, "Sheet1")
    company = next(p for p in infer_columns(df) if p.name == "Company")
    assert (company.null_count, company.unique_count) == (1, 2)


def test_empty_column_is_not_ambiguous(spark):
    df = spark.createDataFrame([(10, None), (20, None)], "`المبيعات` long, `ملاحظات` string")
    p = next(x for x in infer_columns(df) if x.name == "ملاحظات")
    assert p.semantic_role == "unknown" and p.ambiguous is False and "empty" in p.reason


def test_plan_prioritises_measure_and_chart_order(spark):
    df = spark.createDataFrame([("Jarir", 2022, "Q1", 1000, 200), ("Jarir", 2023, "Q1", 1200, 320),
                                ("SACO", 2022, "Q1", 800, 120), ("SACO", 2023, "Q1", 900, 180)],
                               "Company string, Year int, Quarter string, Total_Revenue long, Ecom_Revenue long")
    plan = AnalysisPlan(["Ecom_Revenue", "Total_Revenue"], ["Company", "Year", "Quarter"], [],
                        ["trend", "category_comparison", "share", "distribution"])
    res = analyze(df, plan=plan)
    order = [r["chart_id"] for r in res.charts.select("chart_id", "chart_order").distinct().orderBy("chart_order").collect()]
    assert order[:2] == ["time-line", "category-bar"]
    src = res.results.where(F.col("key") == "chart.category.0.0").collect()[0]["source_columns"]
    assert list(src) == ["Company", "Ecom_Revenue"]


def test_cleaned_currency_columns_give_usd_metrics(spark):
    rows = [("1001", "Electronics", "Phone", "$1,200.00", 12, "$14,400.00"),
            ("1002", "Electronics", "Monitor", "$950.00", 8, "$7,600.00"),
            ("Total Summary", None, None, "$1,075.00 (Avg)", 20, "$22,000.00")]
    df = with_row_index(spark.createDataFrame(rows, "`Product ID` string, Category string, `Product Name` string, "
                                                    "`Unit Price (USD)` string, `Quantity Sold` long, `Total Sales (USD)` string").coalesce(1))
    res = analyze(df)
    reg = {r["key"]: r["value"] for r in res.results.collect()}
    assert reg["sum.Unit Price (USD)"] == 2150 and reg["sum.Quantity Sold"] == 20
    assert reg["sum.Total Sales (USD)"] == 22000 and reg["metric.average.Unit Price (USD)"] == 1075
    assert reg["rows.total"] == 2 and res.currency == "USD"
    assert res.integrity.count() == 0
