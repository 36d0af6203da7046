import os
import tempfile

import pytest

from proofsheet.sources.delimited import read_delimited, sniff_files


def _write(folder, name, data: bytes):
    p = os.path.join(folder, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_bom_csv_and_semicolon(spark):
    d = tempfile.mkdtemp(prefix="ps-csv-")
    _write(d, "a.csv", "﻿الشركة,الإيرادات,الربح\nجرير,1000,200\nالنهدي,900,180\n".encode("utf-8"))
    df = read_delimited(spark, d)
    assert df.columns[:3] == ["الشركة", "الإيرادات", "الربح"]
    assert sorted(r["الإيرادات"] for r in df.collect()) == ["1000", "900"]
    d2 = tempfile.mkdtemp(prefix="ps-csv-")
    _write(d2, "b.csv", b"a;b;;a; \n1;2;3;4;x\n5;  ;7;;\n")
    df2 = read_delimited(spark, d2)
    assert df2.columns[:5] == ["a", "b", "Unnamed: 2", "a.1", "عامود_5"]
    rows = sorted(tuple(r)[:5] for r in df2.collect())
    assert rows == [("1", "2", "3", "4", "x"), ("5", None, "7", None, None)]


def test_binary_and_cp1256(spark):
    d = tempfile.mkdtemp(prefix="ps-csv-")
    _write(d, "bin.csv", b"column\x00name,value\nA,1\n")
    s = {r["path"].rsplit("/", 1)[-1]: r for r in sniff_files(spark, d).collect()}
    assert s["bin.csv"]["error"] == "binary content"
    with pytest.raises(ValueError):
        read_delimited(spark, d)
    d2 = tempfile.mkdtemp(prefix="ps-csv-")
    _write(d2, "w.csv", "المدينة\tالمبيعات\nالرياض\t10\n".encode("cp1256"))
    s2 = sniff_files(spark, d2).collect()[0]
    assert s2["encoding"] == "cp1256" and s2["delimiter"] == "\t"
    df = read_delimited(spark, d2)
    assert df.collect()[0]["المدينة"] == "الرياض"


def test_encoding_is_proven_over_the_whole_file(spark):
    d = tempfile.mkdtemp(prefix="ps-csv-")
    _write(d, "late byte.csv", b"k,v\n" + b"plain,1\n" * 20000 + "الرياض,2\n".encode("cp1256") + b"plain,3\n")
    _write(d, "fine%20.csv", "k,v\nالرياض,1\n".encode("utf-8"))
    with pytest.raises(ValueError, match="late byte.csv: not utf-8"):
        read_delimited(spark, d)
    rows = read_delimited(spark, d, strict=False).collect()
    assert [(r["k"], r["v"]) for r in rows] == [("الرياض", "1")]


def test_header_longer_than_the_sample(spark):
    d = tempfile.mkdtemp(prefix="ps-csv-")
    names = [f"column_number_{i:05d}" for i in range(4000)]
    _write(d, "wide.csv", (",".join(names) + "\n" + ",".join(map(str, range(4000))) + "\n").encode())
    row = sniff_files(spark, d).collect()[0]
    assert row["header"] == names


def test_too_many_fields_rejected(spark):
    d = tempfile.mkdtemp(prefix="ps-csv-")
    _write(d, "long.csv", b"a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError):
        read_delimited(spark, d)


def test_row_numbers_within_each_file(spark):
    from proofsheet.operators.positions import with_file_row_index
    d = tempfile.mkdtemp(prefix="ps-csv-")
    _write(d, "a.csv", b"k,v\na,1\nb,2\nc,3\n")
    _write(d, "b.csv", b"k,v\nx,9\ny,8\n")
    df = with_file_row_index(read_delimited(spark, d))
    got = sorted((r["__source_file"].rsplit("/", 1)[-1], r["k"], r["__source_row"]) for r in df.collect())
    assert got == [("a.csv", "a", 2), ("a.csv", "b", 3), ("a.csv", "c", 4), ("b.csv", "x", 2), ("b.csv", "y", 3)]


def test_analyze_a_csv_folder(spark):
    from proofsheet.plans.analysis import analyze
    d = tempfile.mkdtemp(prefix="ps-csv-")
    _write(d, "sales.csv", "Product ID,Category,Unit Price (USD),Quantity Sold,Total Sales (USD)\n"
           "1001,Electronics,\"$1,200.00\",12,\"$14,400.00\"\n1002,Electronics,$950.00,8,\"$7,600.00\"\n"
           "Total Summary,,\"$1,075.00 (Avg)\",20,\"$22,000.00\"\n".encode("utf-8"))
    res = analyze(read_delimited(spark, d))
    keys = {r["key"]: r["value"] for r in res.results.collect()}
    assert keys["rows.total"] == 2.0 and keys["sum.Total Sales (USD)"] == 22000.0
    assert res.currency == "USD"
    assert [r.source_row for r in res.clean.removed_rows.collect()] == [4]
