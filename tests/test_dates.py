"""One date format per text column (P5)."""

import pytest
from pyspark.sql import functions as F

from proofsheet.functions.expr import parse_date
from proofsheet.operators.clean import clean_dataset
from proofsheet.operators.profile import date_formats
from tests.conftest import frame


def found(spark, cells):
    df = spark.createDataFrame([(i + 2, c) for i, c in enumerate(cells)], "__source_row long, d string").repartition(3)
    return date_formats(df, ["d"]).collect()[0]


@pytest.mark.parametrize("cells, fmt, fitting", [
    (["2020-01-05", "05/01/2020", None, "2020-1-7", "2020-02-30"], "yyyy-M-d", 2),
    ([None, "03/04/2020", "25/12/2020", "12/25/2020"], "M/d/yyyy", 2),       # month first where both fit
    (["25/12/2020", "03/04/2020", "12/25/2020"], "d/M/yyyy", 2),
    (["2020-01-05 10:20:30", "2020-01-05"], "yyyy-M-d HH:mm:ss", 1),
    (["\u0662\u0660\u0662\u0660-\u0660\u0661-\u0660\u0665", " 2020-01-06 "], "yyyy-M-d", 2),
    (["20200105", "20201301"], "yyyyMMdd", 1),
    (["soon", "2020-01-05"], None, None),
    ([None, None], None, None),
    ([], None, None),
])
def test_first_cell_gives_the_format(spark, cells, fmt, fitting):
    r = found(spark, cells)
    assert (r["format"], r["fitting"], r["texts"]) == (fmt, fitting, sum(c is not None for c in cells))


def test_order_is_that_of_the_source_rows_not_of_the_partitions(spark):
    df = spark.createDataFrame([(i, "2020-01-05" if i == 2 else "05/13/2020") for i in range(2, 500)], "__source_row long, d string")
    for n in (1, 3, 8):
        assert date_formats(df.repartition(n, "d"), ["d"]).collect()[0]["format"] == "yyyy-M-d"


def test_cells_of_another_form_are_invalid_and_counted(spark):
    cells = ["2020-01-05", "06/01/2020", None, "x", "2020-01-07"]
    df, prof = frame(spark, [(i, c) for i, c in enumerate(cells)], "k int, When string", {"k": "identifier", "When": "date"})
    res = clean_dataset(df, prof, mode="manual")
    assert [r[0] for r in res.cleaned.orderBy("k").select(F.date_format("When", "yyyy-MM-dd")).collect()] == ["2020-01-05", None, None, None, "2020-01-07"]
    c = res.counters.collect()[0]
    assert (c["date_conversions"], c["invalid_date_cells"]) == (2, 2)


def test_a_column_whose_first_cell_has_no_form_is_read_cell_by_cell(spark):
    df, prof = frame(spark, [(0, "soon"), (1, "2020-01-05"), (2, "2020/02/06")], "k int, When string", {"k": "identifier", "When": "date"})
    got = clean_dataset(df, prof, mode="manual").cleaned.orderBy("k").select(F.date_format("When", "yyyy-MM-dd")).collect()
    assert [r[0] for r in got] == [None, "2020-01-05", "2020-02-06"]


def test_a_summary_row_does_not_give_the_format(spark):
    rows = [("Total", "12/31/2020", 9.0), ("a", "2020-01-05", 4.0), ("b", "2020-01-06", 5.0)]
    df, prof = frame(spark, rows, "Name string, When string, Amount double", {"Name": "dimension", "When": "date", "Amount": "measure"})
    work = clean_dataset(df, prof, mode="manual").cleaned
    assert {r[0] for r in work.select(F.date_format("When", "yyyy-MM-dd")).collect()} == {"2020-01-05", "2020-01-06"}


def test_typed_dates_pass(spark):
    df = spark.sql("select date'2020-01-05' as d")
    assert df.select(parse_date(F.col("d"), df.schema["d"].dataType, "yyyyMMdd").cast("string")).collect()[0][0] == "2020-01-05 00:00:00"
