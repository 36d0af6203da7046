import os
import tempfile

from pyspark.sql import functions as F

from proofsheet.operators import insights as I
from proofsheet.operators import verify as VF
from proofsheet.plans.analysis import analyze
from proofsheet.queries import ORDERS_MAPPING, T
from proofsheet.sources.sinks import write_analysis
from tests.conftest import SF


def test_provenance_flags_unknown_numbers(spark):
    reg = spark.createDataFrame([("k", 42.0)], "key string, value double")
    texts = spark.createDataFrame([("the total is 42",), ("the total is 999",), ("it ended at 999.",), ("«2025-Q1» is a label",)], "text string")
    bad = sorted(r["raw"] for r in VF.unproven_numbers(texts, reg).collect())
    assert bad == ["999", "999"]


def test_analysis_sinks_charts_and_fallback(spark):
    res = analyze(T(spark, SF, "orders"), ORDERS_MAPPING, source_row="o_orderkey")
    out = tempfile.mkdtemp(prefix="ps-out-")
    paths = write_analysis(res, os.path.join(out, "run"))
    back = spark.read.parquet(paths["results"])
    assert back.count() == res.results.count()
    order = [r["chart_id"] for r in res.charts.select("chart_id", "chart_order").distinct().orderBy("chart_order").collect()]
    assert order[0] == "time-line"
    ans = I.fallback_answer("what about quality completeness", res.insights, "summary").collect()[0]["answer"]
    assert "Completeness" in ans
    assert I.fallback_answer("xyz", res.insights, "summary").collect()[0]["answer"] == "summary"
    assert res.integrity.count() == 0
    notes = [r["note"] for r in res.notes.collect()]
    assert notes[0].startswith("The working copy") and res.warnings.count() == 0
