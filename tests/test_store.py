"""Cleaned copies used again (S17) and the preview."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from proofsheet.plans import store as S
from proofsheet.plans.analysis import analyze

MAPPING = {"id": "identifier", "name": "dimension", "amount": "measure", "day": "date"}
ROWS = [(1, "a", "$1.50", "2020-01-05"), (2, None, "(2)", "2020-01-06"), (3, "a", None, "06/02/2020")]


@pytest.fixture()
def place(spark):
    root = tempfile.mkdtemp(prefix="ps-store-")
    spark.createDataFrame(ROWS, "id long, name string, amount string, day string").coalesce(1).write.parquet(f"{root}/in")
    return root


def copy(spark, place, **kw):
    return S.cleaned_copy(spark, f"{place}/store", f"{place}/in", MAPPING, source_row="id", format="parquet", **kw)


def cells(res):
    return [tuple(r) for r in res.cleaned.orderBy("id").collect()]


def test_second_run_cleans_nothing_and_changes_are_seen(spark, place, monkeypatch):
    first, reused = copy(spark, place)
    assert not reused and cells(first)[1][2] == "غير محدد"
    clean = S.clean_dataset
    monkeypatch.setattr(S, "clean_dataset", lambda *a, **k: pytest.fail("cleaned again"))
    again, reused = copy(spark, place)
    assert reused and cells(again) == cells(first)
    assert [tuple(r) for r in again.counters.collect()] == [tuple(r) for r in first.counters.collect()]
    assert [p.name for p in again.profiles] == list(MAPPING)
    res = analyze(None, MAPPING, cleaned=again)
    assert res.results.where("key = 'rows.total'").collect()[0]["value"] == 3.0
    monkeypatch.setattr(S, "clean_dataset", clean)
    assert not copy(spark, place, mode="manual")[1]                       # another mode
    spark.createDataFrame([(4, "b", "7", "2020-01-08")], "id long, name string, amount string, day string").coalesce(1) \
        .write.mode("append").parquet(f"{place}/in")
    more, reused = copy(spark, place)                                     # another file
    assert not reused and len(cells(more)) == 4
    one = spark.createDataFrame([("name", 2, "z")], "column string, source_row long, value string")
    assert not copy(spark, place, mode="manual", overrides=one)[1] and copy(spark, place, mode="manual", overrides=one)[1]
    assert not copy(spark, place, mode="manual", overrides=one.withColumn("value", F.lit("y")))[1]


def test_half_written_copies_are_not_found_and_eviction(spark, place, monkeypatch):
    enter = S._enter
    def lost(*a):
        raise RuntimeError("driver lost")
    monkeypatch.setattr(S, "_enter", lost)
    with pytest.raises(RuntimeError):
        copy(spark, place)
    monkeypatch.setattr(S, "_enter", enter)
    assert not copy(spark, place)[1] and copy(spark, place)[1]
    assert S.evict(spark, f"{place}/store", dt.datetime(2020, 1, 1)) == 0 and copy(spark, place)[1]
    assert S.evict(spark, f"{place}/store", dt.datetime(2100, 1, 1)) == 1
    assert S.evict(spark, f"{place}/store", dt.datetime(2100, 1, 1)) == 0
    assert not copy(spark, place)[1] and copy(spark, place)[1]


def test_preview_marks_repaired_cells(spark, place):
    shown = S.preview(copy(spark, place)[0], MAPPING)
    rows = {r["id"]: r for r in shown.rows.collect()}
    assert rows[1]["day"] == "2020-01-05T00:00:00" and rows[1]["repaired_columns"] == []
    assert rows[2]["repaired_columns"] == ["name"] and rows[2]["amount"] == -2.0
    assert rows[3]["repaired_columns"] == ["amount"] and rows[3]["day"] is None       # another form than the column's
    profile = {r["name"]: r for r in shown.profile.collect()}
    assert profile["amount"]["inferred_type"] == "number" and profile["day"]["null_count"] == 1
