"""Fingerprints (W2, A15), positions (W3, W4), pages (T8), distinct counts (A14), reconciliation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from proofsheet.operators import fingerprints
from proofsheet.operators.clean import drop_duplicates_keep_first, duplicate_rows
from proofsheet.operators.explore import PageDirectory
from proofsheet.operators.positions import dense_position
from proofsheet.operators.profile import column_stats, infer_columns
from proofsheet.operators.quality import duplicate_row_count
from proofsheet.operators.verify import compare_groups, reconcile


def rows_with_repeats(n=400, seed=1):
    rnd = random.Random(seed)
    values = [(a, b, c) for a in (None, "", "x", "y:1") for b in (None, 0.0, -0.0, 1.5, float("nan")) for c in (None, 1, 2)]
    return [(i, *rnd.choice(values), 1) for i in range(n)] + [(n + i, "hot", 1.0, 1, 1) for i in range(n // 2)]


def key(r):
    return (r[1], "nan" if r[2] != r[2] else None if r[2] is None else r[2] + 0.0, r[3])


@pytest.mark.parametrize("narrow", [False, True])
def test_duplicates_by_fingerprint(spark, monkeypatch, narrow):
    if narrow:  # three fingerprints: all of them collide
        wide = fingerprints.fingerprint
        monkeypatch.setattr(fingerprints, "fingerprint", lambda df, c: F.pmod(wide(df, c), F.lit(3)))
    rows = rows_with_repeats()
    df = spark.createDataFrame(rows, "__source_row long, a string, b double, c int, __count int").repartition(5)
    want = {}
    for r in rows:
        first, n = want.get(key(r), (r[0], 0))
        want[key(r)] = (min(first, r[0]), n + 1)
    kept = drop_duplicates_keep_first(df, carry=["__count"])
    got = {r["__source_row"]: (r["__dups"], r["__n"], r["__count"]) for r in kept.collect()}
    assert got == {first: (n - 1, n, n) for first, n in want.values()}
    assert duplicate_row_count(df).first()[0] == len(rows) - len(want)
    assert duplicate_rows(df, kept).count() == len(rows) - len(want)


def test_no_whole_rows_are_shuffle_keys(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("doc_id", "__source_row")
    plan = drop_duplicates_keep_first(df)._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning" in line and "text" in line for line in plan.splitlines())


def test_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "__source_row long, a string")
    assert drop_duplicates_keep_first(df).count() == 0 and duplicate_row_count(df).first()[0] == 0


def test_positions_of_spread_keys(spark):
    rnd = random.Random(4)
    keys = list({rnd.randrange(-2**62, 2**62) for _ in range(3000)})
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(6)
    out = dense_position(df, "k", partitions=7)
    assert [r["k"] for r in out.orderBy("__position").collect()] == sorted(keys)
    assert out.agg(F.min("__position"), F.max("__position")).first()[:] == (0, 2999)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "__pid" in plan  # over one row a partition


@pytest.mark.parametrize("descending", [False, True])
def test_pages_equal_the_offset_form(spark, monkeypatch, descending):
    from proofsheet.operators import explore
    monkeypatch.setattr(explore, "RANGE_ROWS", 37)
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, rnd.choice([None, 1.0, 2.0, 2.0, 3.5])) for i in range(300)], "__source_row long, v double").repartition(4)
    directory = PageDirectory(df, "v", descending)
    assert len(directory.counts) > 4
    order = [F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last(), "__source_row"]
    every = [tuple(r) for r in df.orderBy(*order).collect()]
    for page in (0, 1, 4, 5, 6, 99):
        got = directory.page(page)
        assert [tuple(r) for r in got.collect()] == every[page * 50:page * 50 + 50]
        assert "Offset" not in got._jdf.queryExecution().optimizedPlan().toString()
    for at in (0, 49, 210, 250, 299):
        assert [tuple(r) for r in directory.after(every[at][1], every[at][0]).collect()] == every[at + 1:at + 51]
    whole = PageDirectory(df)
    assert [r[0] for r in whole.page(1, 10).collect()] == list(range(10, 20))


def test_distinct_counts_are_exact(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(2**60) if i % 2 else None, i % 20_000 - 9, rnd.choice([0.0, -0.0, float("nan"), None, 1.0]), f"t{i}",
             dt.date(2020, 1, 1) + dt.timedelta(i % 50), [i % 3]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "a long, b long, c int, d double, e string, f date, g array<int>")
    want = [30_000, len({r[1] for r in rows} - {None}), 20_000, 2, 30_000, 50, 3]
    stats = column_stats(df).orderBy("ordinal").collect()
    assert [r["unique_count"] for r in stats] == want and all(r["unique_exact"] for r in stats)
    assert [r["null_count"] for r in stats][1] == 15_000
    profiles = infer_columns(df.drop("g"))
    assert [p.unique_count for p in profiles] == want[:6] and all(p.unique_exact for p in profiles)
    assert not any(r["unique_exact"] for r in column_stats(df.drop("g"), distinct="approx").collect())


def test_no_row_per_cell(spark, monkeypatch):
    seen = []
    explode = F.explode
    monkeypatch.setattr(F, "explode", lambda *a: seen.append(a) or explode(*a))
    column_stats(spark.read.parquet("/root/testdata/sf0.001/orders.parquet")).collect()
    assert not seen


def test_reconciliation_sees_missing_groups(spark):
    df = spark.createDataFrame([(k, float(v)) for k in ("a", "b", None, "c") for v in range(4)], "k string, v double")
    sums = df.groupBy("k").agg(F.sum("v").alias("s"))
    assert reconcile(sums, df, ["k"], "s", "sum", "v", complete=True).count() == 0
    broken = sums.where("k is null or k <> 'a'").withColumn("s", F.when(F.col("k").isNull(), 9.0).otherwise(F.col("s"))).union(
        spark.createDataFrame([("z", 6.0)], "k string, s double"))
    assert sorted(map(str, (r["k"] for r in reconcile(broken, df, ["k"], "s", "sum", "v", complete=True).collect()))) == ["None", "a", "z"]
    assert sorted(map(str, (r["k"] for r in reconcile(broken, df, ["k"], "s", "sum", "v").collect()))) == ["None", "z"]


def test_groups_of_two_tables(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 5), ("same", 7)], "k string, v int")
    right = spark.createDataFrame([("a", 2), ("a", 3), ("c", 1), (None, 5), ("same", 7)], "k string, v int")
    got = {(r["k"], r["difference"], r["left_rows"], r["right_rows"]) for r in compare_groups(left, right, ["k"], ["v"]).collect()}
    assert got == {("a", "altered", 2, 2), ("b", "missing right", 1, None), ("c", "missing left", None, 1)}
