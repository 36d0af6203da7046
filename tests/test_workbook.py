import os
import tempfile

from proofsheet.operators.profile import infer_columns
from proofsheet.sources.workbook import read_sheet, workbook_inventory
from tests.xlsx_fixture import write_xlsx


def _book():
    d = tempfile.mkdtemp(prefix="ps-xlsx-")
    write_xlsx(os.path.join(d, "sales.xlsx"), [
        ("المبيعات", [["التاريخ", "المدينة", "الإيرادات", "الربح"],
                      [("date", 45658), "الرياض", 1000, 200],
                      [("date", 45659), "جدة", 900, 180],
                      [("date", 45660), "   ", 800, 150]]),
        ("تدقيق الحسابات", [["note"]]),
        ("صيغ", [["الكمية", "السعر", "الإجمالي"], [2, 10, ("formula", "A2*B2")]]),
    ])
    return d


def test_inventory_and_roles(spark):
    d = _book()
    write_xlsx(os.path.join(d, "blank.xlsx"), [("blank", [])])
    inv = {r["sheet"]: r for r in workbook_inventory(spark, d).collect()}
    assert inv["المبيعات"]["rows"] == 4 and inv["المبيعات"]["columns"] == 4 and inv["المبيعات"]["has_data"]
    assert not inv["تدقيق الحسابات"]["has_data"]
    assert (inv["blank"]["rows"], inv["blank"]["columns"], inv["blank"]["has_data"]) == (0, 0, False)
    df = read_sheet(spark, d, "المبيعات")
    roles = {p.name: p.semantic_role for p in infer_columns(df)}
    assert roles["التاريخ"] == "date" and roles["الإيرادات"] == "measure" and roles["المدينة"] == "dimension"
    rows = sorted(df.collect(), key=lambda r: r["__source_row"])
    assert rows[0]["التاريخ"] == "2025-01-01" and rows[2]["المدينة"] is None


def test_formula_text_kept(spark):
    df = read_sheet(spark, _book(), "صيغ")
    assert df.collect()[0]["الإجمالي"] == "=A2*B2"


def test_blank_rows_are_kept(spark):
    d = tempfile.mkdtemp(prefix="ps-xlsx-")
    write_xlsx(os.path.join(d, "gaps.xlsx"), [("S", [["a", "b"], [1, 2], [None, None], [3, 4]])])
    rows = sorted(read_sheet(spark, d, "S").collect(), key=lambda r: r["__source_row"])
    assert [r["__source_row"] for r in rows] == [2, 3, 4]
    assert rows[1]["a"] is None and rows[2]["a"] == "3"
