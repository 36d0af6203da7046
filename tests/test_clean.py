from pyspark.sql import functions as F

from proofsheet.operators.clean import clean_dataset
from tests.conftest import frame

B1 = [("1001", "Electronics", "Laptop", "$1,200.00", 12, "$14,400.00"),
      ("1002", "Electronics", "Phone", "$950.00", 8, "$7,600.00"),
      ("Total Summary", None, None, "$1,075.00 (Avg)", 20, "$22,000.00")]
B1_SCHEMA = "`Product ID` string, Category string, `Product Name` string, `Unit Price (USD)` string, `Quantity Sold` long, `Total Sales (USD)` string"


def test_summary_row_and_currency(spark):
    df, prof = frame(spark, B1, B1_SCHEMA)
    roles = {p.name: p.semantic_role for p in prof}
    assert roles["Product ID"] == "identifier"
    assert roles["Unit Price (USD)"] == "measure" and roles["Total Sales (USD)"] == "measure"
    res = clean_dataset(df, prof)
    c = res.counters.collect()[0]
    assert c["output_rows"] == 2 and c["excluded_summary_rows"] == 1
    assert c["numeric_conversions"] == 4 and c["invalid_numeric_cells"] == 0
    assert [r.source_row for r in res.removed_rows.collect()] == [4]
    tot = res.cleaned.agg(F.avg("Unit Price (USD)"), F.sum("Quantity Sold"), F.sum("Total Sales (USD)")).collect()[0]
    assert tuple(tot) == (1075.0, 20, 22000.0)


def test_row_formulas_and_empty_column(spark):
    rows = [("أ", "2", "10", "=B2*C2", None), ("ب", "3", "20", "=B3*C3", None), ("الإجمالي العام", "=SUM(B2:B3)", None, "=SUM(D2:D3)", None)]
    schema = "`المنتج` string, `الكمية` string, `سعر الوحدة` string, `إجمالي المبلغ` string, `ملاحظات فارغة` string"
    df, prof = frame(spark, rows, schema)
    res = clean_dataset(df, prof)
    out = res.cleaned.orderBy("__source_row").select("إجمالي المبلغ").collect()
    assert [r[0] for r in out] == [20.0, 60.0]
    assert res.excluded_empty_columns == ["ملاحظات فارغة"]
    c = res.counters.collect()[0]
    assert c["formula_calculations"] == 2 and c["excluded_summary_rows"] == 1


def test_unsafe_formulas_rejected(spark):
    rows = [("2", "10", "=A3*B3"), ("3", "20", "=SUM(A2:B2)")]
    df, prof = frame(spark, rows, "`الكمية` string, `سعر الوحدة` string, `إجمالي المبلغ` string")
    res = clean_dataset(df, prof, mode="manual")
    out = [r[0] for r in res.cleaned.orderBy("__source_row").select("إجمالي المبلغ").collect()]
    c = res.counters.collect()[0]
    assert out == [None, None] and c["formula_calculations"] == 0 and c["invalid_numeric_cells"] == 2


def test_sequential_and_derived(spark):
    ids = [1001, 1002, 1003, 1004, 1005, 1006, 1007, None, 1009]
    price = [100, 200, 300, 180, 250, 350, 310, 450, 90]
    qty = [1, 2, 3, 15, 5, 6, 7, 22, 9]
    total = [100, 400, 900, None, 1250, 2100, 2170, 9900, 810]
    rows = [(ids[i], f"P{i}", float(price[i]), float(qty[i]), None if total[i] is None else float(total[i])) for i in range(9)]
    df, prof = frame(spark, rows, "`Product ID` long, `Product Name` string, `Unit Price` double, `Quantity Sold` double, `Total Sales` double")
    res = clean_dataset(df, prof)
    got = {r["__source_row"]: r for r in res.cleaned.collect()}
    assert got[9]["Product ID"] == 1008
    assert got[5]["Total Sales"] == 2700.0
    loc = sorted((r.column, r.source_row) for r in res.missing_locations.collect())
    assert loc == [("Product ID", 9), ("Total Sales", 5)]
    assert res.counters.collect()[0]["remaining_missing_values"] == 0
    strategies = sorted((r.column, r.strategy) for r in res.actions.collect())
    assert strategies == [("Product ID", "sequential"), ("Total Sales", "derived")]


def test_imputation_by_role(spark):
    rows = [(100.0, 1.0, "A", "2025-01-01", "A-10"), (None, None, None, None, None), (300.0, 100.0, "B", "2025-01-03", "B-99")]
    schema = "`Revenue (SAR)` double, Score double, Category string, `Order Date` string, `Reference ID` string"
    mapping = {"Revenue (SAR)": "measure", "Score": "measure", "Category": "dimension", "Order Date": "date", "Reference ID": "identifier"}
    df, prof = frame(spark, rows, schema, mapping)
    res = clean_dataset(df, prof)
    r = res.cleaned.where("__source_row = 3").collect()[0]
    assert r["Revenue (SAR)"] == 200.0 and r["Score"] == 50.5 and r["Category"] == "غير محدد"
    assert r["Order Date"] is None and r["Reference ID"] is None


def test_duplicates_keep_first(spark):
    df, prof = frame(spark, [("A", 10.0), ("A", 10.0), ("A", 11.0)], "Category string, Amount double", {"Category": "dimension"})
    res = clean_dataset(df, prof)
    assert res.cleaned.count() == 2
    assert [r.source_row for r in res.removed_rows.collect()] == [3]


def test_manual_overrides(spark):
    rows = [(1001.0, 10.0, 1.0, 100.0), (None, 20.0, 2.0, None), (1003.0, 30.0, 3.0, 900.0)]
    df, prof = frame(spark, rows, "`Product ID` double, `Unit Price` double, `Quantity Sold` double, `Total Sales` double")
    ov = spark.createDataFrame([("Product ID", 3, "1002"), ("Total Sales", 3, "400")], "column string, source_row long, value string")
    res = clean_dataset(df, prof, mode="manual", overrides=ov)
    r = res.cleaned.where("__source_row = 3").collect()[0]
    assert r["Product ID"] == 1002.0 and r["Total Sales"] == 400.0
    assert {a.strategy for a in res.actions.collect()} == {"manual"}


def test_manual_mode_keeps_missing(spark):
    df, prof = frame(spark, [("A", 10.0), (None, None)], "Category string, Amount double", {"Category": "dimension"})
    res = clean_dataset(df, prof, mode="manual")
    r = res.cleaned.where("__source_row = 3").collect()[0]
    assert r["Category"] is None and r["Amount"] is None
    assert {a.strategy for a in res.actions.collect()} == {"retained"}
