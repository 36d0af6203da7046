from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofsheet.functions.expr import parse_numeric_text
from proofsheet.operators import metrics as M
from proofsheet.operators.clean import clean_dataset, drop_duplicates_keep_first
from proofsheet.operators.positions import exact_quantiles
from proofsheet.operators.profile import infer_columns
from proofsheet.queries import ORDERS_MAPPING, T
from tests.conftest import SF

amounts = st.decimals(min_value=Decimal("-1e9"), max_value=Decimal("1e9"), places=2, allow_nan=False, allow_infinity=False)
styles = st.sampled_from(["plain", "grouped", "usd", "sar", "paren", "percent", "arabic"])
AR = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")


def render(v: Decimal, style: str) -> tuple[str, float]:
    a = abs(v)
    grouped = f"{a:,.2f}"
    sign = "-" if v < 0 else ""
    if style == "plain":
        return f"{v:.2f}", float(v)
    if style == "grouped":
        return sign + grouped, float(v)
    if style == "usd":
        return f"{sign}${grouped} USD", float(v)
    if style == "sar":
        return f"{sign}{grouped} ر.س", float(v)
    if style == "paren":
        return f"({grouped})", -float(a)
    if style == "percent":
        return f"{v:.2f} %", float(v)
    return (sign + f"{a:.2f}".translate(AR).replace(".", "٫")), float(v)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(amounts, styles), min_size=20, max_size=60))
def test_number_parse_round_trip(spark, cases):
    rows = [render(v, s) for v, s in cases]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = [r[0] for r in df.select(parse_numeric_text(F.col("t"))).collect()]
    assert got == [e for _, e in rows]


def _invariant(fn, df):
    outs = []
    for n in (1, 3, 8):
        outs.append(sorted(tuple(r) for r in fn(df.repartition(n)).collect()))
    assert outs[0] == outs[1] == outs[2]


def test_partition_invariance(spark, monkeypatch):
    from proofsheet.operators import positions
    monkeypatch.setattr(positions, "PERCENTILE_MAP_LIMIT", 0)  # exercise the distributed rank path
    li = T(spark, SF, "lineitem")
    _invariant(lambda d: M.category_topk(d, "l_returnflag", ["l_extendedprice", "l_quantity"]), li)
    _invariant(lambda d: M.kpi_frame(d, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])[0], li)
    _invariant(lambda d: exact_quantiles(d, "l_extendedprice", [0.25, 0.5, 0.75], ["l_linestatus"]), li)
    docs = T(spark, SF, "documents").select(F.col("doc_id").alias("__source_row"), "text", "lang", "source")
    _invariant(lambda d: drop_duplicates_keep_first(d), docs)


def test_cleaning_conserves_rows_and_is_idempotent(spark):
    o = T(spark, SF, "orders")
    k = F.col("o_orderkey")
    dirty = o.select(k.alias("__source_row"), "o_orderkey", "o_orderstatus",
                     F.when(k % 17 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
                     F.when(k % 23 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    dirty = dirty.unionByName(dirty.where(k % 101 == 0).withColumn("__source_row", F.col("__source_row") + 1_000_000))
    prof = infer_columns(dirty, ORDERS_MAPPING)
    res = clean_dataset(dirty, prof)
    c = res.counters.collect()[0]
    assert c["input_rows"] == c["output_rows"] + c["removed_duplicate_rows"] + c["excluded_summary_rows"]
    assert res.removed_rows.count() == c["removed_duplicate_rows"] > 0
    again = clean_dataset(res.cleaned, res.profiles).counters.collect()[0]
    assert again["output_rows"] == c["output_rows"] and again["imputed_values"] == 0 and again["removed_duplicate_rows"] == 0


def test_driver_contract(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() > 0 and out.columns == ["key", "value", "operation", "source_columns", "query"]
    assert set(E.oracle_sql()) <= set(E.queries())
