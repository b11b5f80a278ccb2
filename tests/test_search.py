"""The batch search holds bounded memory, and contexts make documents of the hits only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from fixtures_small import SMALL
from parcelsight.functions.vector_math import unit_rows
from parcelsight.operators import feeds, rag, vectors
from parcelsight.plans import fixtures as fx
from parcelsight.plans import queries


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    m, q = rng.normal(size=(90, 6)), rng.normal(size=(12, 6))
    m[60:] = m[:30] * 2.0      # as far from every query as another vector, but not equal to it
    rows = [(f"d{i * 7 % 90:02d}", [float(x) for x in v]) for i, v in enumerate(m)]
    rows += rows[:9] + [(None, rows[4][1])]
    asked = [(i // 2, [float(x) for x in q[i // 2]]) for i in range(12)] + [(i, [float(x) for x in q[i]]) for i in range(6, 12)]
    return (spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4).cache(),
            spark.createDataFrame(asked, "query_id int, embedding array<double>").cache(), rows, asked)


def brute(rows, asked, k):
    m = unit_rows(np.array([v for _, v in rows]))
    pairs: dict = {}
    for query, v in asked:
        d = np.round(1 - m @ unit_rows(np.array([v]))[0], 9)
        pairs.setdefault(query, []).extend((x, i is not None, i or "", i) for x, (i, _) in zip(d, rows))
    return {query: [i for *_, i in sorted(found)[:k]] for query, found in pairs.items()}


def lists(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("k", [1, 4, 60])
def test_ties_repeats_and_missing_ids(tables, k):
    corpus, queries_, rows, asked = tables
    for values, tile in ((6 * 100, 8192), (6 * 3, 7)):
        assert lists(vectors.topk_batch(queries_, corpus, k, max_values=values, tile_rows=tile)) == brute(rows, asked, k)


def test_queries_are_not_sent_whole(spark, tables, monkeypatch):
    """Neither the driver nor a task holds all queries: they are dealt into blocks."""
    corpus, queries_, rows, asked = tables
    model = vectors.train_cells(corpus, 4)
    cells = vectors.assign_cells(corpus, model)

    def refused(*_):
        raise AssertionError("a table was sent to every task")
    monkeypatch.setattr(SparkContext, "broadcast", refused)
    assert lists(vectors.topk_batch(queries_, corpus, 4)) == brute(rows, asked, 4)
    assert lists(vectors.ann_topk_batch(queries_, cells, model, 4, nprobe=4)) == brute(rows, asked, 4)


def test_a_task_holds_what_k_rows_need(monkeypatch):
    """Of many vectors at one distance a query keeps k, of vectors with k ids each one; candidates are kept in portions."""
    monkeypatch.setattr(vectors, "PAIRS_HELD", 50)
    monkeypatch.setattr(vectors, "IDS_HELD", 20)
    ray = np.array([1.0, 2.0, 3.0])
    found = {}
    for many in (1, 5):
        block = vectors._Block(5, 3, 100, None, 0)
        block.ask(pa.record_batch([pa.array([ray.tolist()] * 8), pa.array(range(8))], ["embedding", "query_id"]))
        for low in range(0, 400, 100):
            block.meet(pa.record_batch([pa.array([(ray * (i + 1)).tolist() for i in range(low, low + 100)]),
                                        pa.array([[f"{i:03d}-{n}" for n in range(many)] for i in range(low, low + 100)])],
                                       ["embedding", "ids"]))
        assert len(block.best.seq) == 8 * 5 and len(block.best.ids) <= 120
        out = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("distance", pa.float64())])
        found[many] = sorted(set(pa.Table.from_batches(block.found(out))["id"].to_pylist()))[:5]
    assert found == {1: [f"{i:03d}-0" for i in range(5)], 5: [f"000-{n}" for n in range(5)]}


def test_points_of_a_fit_are_stored(spark, tables, monkeypatch):
    """A fit reads its points several times; the corpus behind them is read once."""
    plans, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), fit(self, df))[1])
    vectors.train_cells(tables[0], 3)
    assert "Exchange" not in plans[0] and "Aggregate" not in plans[0]


def test_index_rows_do_without_timelines(spark):
    lean, full = fx.ready_vectors(spark, SMALL), vectors.index_rows(fx.ai_ready(spark, SMALL))
    assert lean.columns == full.columns and lean.exceptAll(full).isEmpty() and full.exceptAll(lean).isEmpty()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Delivery confirmed" not in plan(lean) and "date_format" not in plan(lean)
    assert len(plan(lean)) < len(plan(full))


def test_documents_are_made_of_hits_only(spark):
    """Wide rows are made, and travel, for deliveries that were found, not for all of them."""
    hits = queries._hits(spark, SMALL)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("LeftSemi")
    wanted = spark.createDataFrame([(i,) for i in ("del-00000003", "none")], "id string")
    every = fx.ai_ready(spark, SMALL).select(*feeds.SEARCH_RESULT)
    some = fx.ai_ready(spark, SMALL, hits.select("id")).select(*feeds.SEARCH_RESULT)
    found = every.join(hits.select("id").distinct(), "id").select(*every.columns)
    assert some.exceptAll(found).isEmpty() and found.exceptAll(some).isEmpty() and not found.isEmpty()
    assert fx.ai_ready(spark, SMALL, wanted).where("id = 'none'").isEmpty()


def test_summaries_leave_blocks_alone(spark, make):
    from parcelsight.operators import enrich as en
    hits = en.enrich(make({}, {"id": "b"})).withColumns({"query_id": F.lit(1), "rank": F.length("id")})
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "--- Delivery" in text(rag.context(hits)) and "--- Delivery" not in text(rag.fleet_summary(hits))
    head = rag.fleet_summary(hits).first()["summary"]
    assert rag.context(hits).first()["context"].startswith(head)
