"""Plan-level guards over the library's own queries (sf0.001); tests/llm guards the training-data queries."""

import __spark_entry__ as E
from proofsheet.queries import QUERIES
from tests.conftest import SF

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products_anywhere(spark):
    bad = {}
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, SF))
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_topk_and_pushdown(spark):
    plan = _plan(E.queries()["category_topk"](spark, SF))
    assert "TakeOrderedAndProject" in plan
    q = E.queries()["question_aggregate"](spark, SF)
    text = q._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text or "BroadcastExchange" in text
