"""Operators against tiny pure-Python models of the same rules (hypothesis)."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofsheet.operators.clean import drop_duplicates_keep_first, sequential_identifier

cell = st.one_of(st.none(), st.sampled_from(["a", "b"]))
num = st.one_of(st.none(), st.sampled_from([1.0, 2.0]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(cell, num), min_size=1, max_size=40))
def test_keep_first_dedupe_model(spark, rows):
    df = spark.createDataFrame([(i + 2, a, b) for i, (a, b) in enumerate(rows)], "__source_row long, a string, b double")
    got = sorted(r["__source_row"] for r in drop_duplicates_keep_first(df).collect())
    seen, want = set(), []
    for i, r in enumerate(rows):
        if r not in seen:
            seen.add(r)
            want.append(i + 2)
    assert got == want


def _model_sequence(values):
    """Numeric rule: ≥ 3 known integer ids, ≥ 85 % share one offset (value −
    position) → fill base + position; smallest offset wins a tie."""
    known = [(p, v) for p, v in enumerate(values) if v is not None]
    if len(known) < 3 or all(v is not None for v in values):
        return values
    offsets = Counter(v - p for p, v in known)
    base, hits = min(offsets.items(), key=lambda kv: (-kv[1], kv[0]))
    if hits / len(known) < 0.85:
        return values
    return [base + p if v is None else v for p, v in enumerate(values)]


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 1000), st.lists(st.booleans(), min_size=4, max_size=40), st.lists(st.integers(0, 39), max_size=3))
def test_sequential_repair_model(spark, start, present, noise):
    values = [start + i if keep else None for i, keep in enumerate(present)]
    for j in noise:  # a few out-of-sequence ids
        if j < len(values) and values[j] is not None:
            values[j] += 7
    df = spark.createDataFrame([(i + 2, v) for i, v in enumerate(values)], "__source_row long, id long")
    out, _ = sequential_identifier(df, "id")
    got = [r["id"] for r in out.orderBy("__source_row").collect()]
    assert got == _model_sequence(values)
