"""No registered training-data query contains a cross product (sf0.001)."""

import pytest

from proofsheet.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_no_cross_products(spark, name):
    plan = LLM_QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
