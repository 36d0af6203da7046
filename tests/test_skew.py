"""A third of all rows on one key/value: results stay exact and whole."""

import numpy as np
from pyspark.sql import functions as F

from proofsheet.operators import metrics as M
from proofsheet.operators.clean import drop_duplicates_keep_first
from proofsheet.operators.positions import dense_position, exact_quantiles


def _skewed(spark, n=30_000):
    rng = np.random.default_rng(7)
    vals = rng.normal(100, 30, n).round(2)
    vals[: n // 3] = 42.0                      # one hot value
    keys = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c"], n))
    rows = [(int(i), str(k), float(v)) for i, (k, v) in enumerate(zip(keys, vals))]
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(8), vals, keys


import pytest

from proofsheet.operators import positions


@pytest.mark.parametrize("limit", [0, 10_000_000])  # range-partitioned ranks, then the checked map path
def test_quantiles_with_a_hot_value(spark, monkeypatch, limit):
    monkeypatch.setattr(positions, "PERCENTILE_MAP_LIMIT", limit)
    df, vals, keys = _skewed(spark)
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.75, 0.9]).collect()}
    for p, q in got.items():
        assert abs(q - float(np.quantile(vals, p))) < 1e-9
    grouped = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(df, "v", [0.5], ["k"]).collect()}
    for k in ("hot", "a", "b", "c"):
        assert abs(grouped[(k, 0.5)] - float(np.quantile(vals[keys == k], 0.5))) < 1e-9


def test_hot_duplicate_group_and_topk(spark):
    df, vals, keys = _skewed(spark)
    content = df.select(F.col("id").alias("__source_row"), "k", "v")
    kept = drop_duplicates_keep_first(content)
    hot = kept.where((F.col("k") == "hot") & (F.col("v") == 42.0)).collect()
    assert len(hot) == 1 and hot[0]["__source_row"] == 0 and hot[0]["__dups"] == len(vals) // 3 - 1
    top = M.category_topk(df, "k", ["v"]).collect()
    total = {r["category"]: r["value_0"] for r in top}
    assert abs(total["hot"] - 42.0 * (len(vals) // 3)) < 1e-6


def test_dense_position_is_exact(spark):
    df, _, _ = _skewed(spark)
    sub = df.where(F.col("id") % 7 != 0)
    pos = dense_position(sub, "id").collect()
    ordered = sorted((r["id"], r["__position"]) for r in pos)
    assert [p for _, p in ordered] == list(range(len(ordered)))
