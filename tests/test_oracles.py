"""Every registered query with an oracle equals it; the others return rows."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_points
from compare import compare, oracle_connection
from fixtures_small import SMALL

# the training-text queries have tests of their own and may be absent
OWN = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: v for k, v in entry_points.queries().items() if not OWN.match(k)}
ORACLES = {k: v for k, v in entry_points.oracle_sql().items() if not OWN.match(k)}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        assert compare(con, df, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 20


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"embedded_deliveries", "ann_topk", "ann_recall", "sq8_topk"}
