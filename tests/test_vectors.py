from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures_small import SMALL
from parcelsight.functions.vector_math import cosine_distance, distance_to
from parcelsight.operators import enrich as en
from parcelsight.operators import vectors
from parcelsight.plans import fixtures as fx


@pytest.fixture(scope="module")
def data(spark):
    """600 vectors, a third of them copies of one, some without direction, length or value."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(600, 12)).astype(np.float32)
    m[::3] = m[0]
    rows = [(f"d{i:04d}", [float(x) for x in v]) for i, v in enumerate(m)]
    odd = [("odd-zero", [0.0] * 12), ("odd-short", [1.0] * 3), ("odd-null", None)]
    corpus = spark.createDataFrame(rows + odd, "id string, embedding array<float>").repartition(5)
    q = rng.normal(size=(40, 12)).astype(np.float32)
    q[0] = m[0]
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)],
                                    "query_id int, embedding array<float>")
    return corpus.cache(), queries.cache(), m.astype(float), q.astype(float), [r[0] for r in rows]


def brute(m, q, names, k):
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    d = np.round(1 - unit(q) @ unit(m).T, 9)
    return {i: [names[j] for j in sorted(range(len(names)), key=lambda j: (row[j], names[j]))[:k]]
            for i, row in enumerate(d)}


def lists(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_batch_search_equals_brute_force(data):
    corpus, queries, m, q, names = data
    assert lists(vectors.topk_batch(queries, corpus, 7)) == brute(m, q, names, 7)


def test_tiled_search_equals_brute_force(data):
    corpus, queries, m, q, names = data
    got = vectors.topk_batch(queries, corpus, 7, max_values=12 * 11, tile_rows=100)
    assert lists(got) == brute(m, q, names, 7)


def test_k_beyond_the_corpus(data):
    corpus, queries, m, q, names = data
    assert lists(vectors.topk_batch(queries.limit(2), corpus, 1000)) == brute(m, q[:2], names, 600)


def test_one_query_equals_batch(data):
    corpus, queries, m, q, names = data
    hits = vectors.nearest(corpus, list(q[5]), 9).collect()
    assert [r["id"] for r in hits] == brute(m, q, names, 9)[5]
    assert hits[0]["score"] == pytest.approx(1 - hits[0]["distance"], abs=1e-6)


def test_column_and_constant_distances_agree(data):
    corpus, _, m, q, names = data
    lit = F.lit([float(x) for x in q[1]])
    rows = corpus.select("id", F.round(cosine_distance(F.col("embedding"), lit), 9).alias("a"),
                         distance_to(list(q[1]))("embedding").alias("b")).collect()
    assert all(r["a"] is None and r["b"] is None for r in rows if r["id"].startswith("odd"))
    assert all(abs(r["a"] - r["b"]) < 2e-9 for r in rows if not r["id"].startswith("odd"))


def test_missing_distance_scores_one(data):
    corpus, _, _, q, _ = data
    rows = vectors.nearest(corpus, list(q[0]), 603).where("distance is null").collect()
    assert {r["id"] for r in rows} == {"odd-zero", "odd-short", "odd-null"} and {r["score"] for r in rows} == {1.0}


def test_cells_find_what_exact_search_finds(spark, data, tmp_path):
    corpus, queries, m, q, names = data
    model = vectors.train_cells(corpus.where("id like 'd%'"), 8)
    vectors.write_cells(vectors.assign_cells(corpus.where("id like 'd%'"), model), str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    assert cells.count() == 600
    everything = vectors.ann_topk_batch(queries, cells, model, 7, nprobe=8)
    assert lists(everything) == brute(m, q, names, 7)
    in_blocks = vectors.ann_topk_batch(queries, cells, model, 7, nprobe=8, max_values=12 * 15)
    assert lists(in_blocks) == brute(m, q, names, 7)
    one = cells.withColumn("is_ai_ready", F.lit(True))
    plan = vectors.ann_topk(one, model, list(q[1]), 7, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_recall_grows_with_probes(spark):
    rows = __import__("__spark_entry__").queries()["ann_recall"](spark, SMALL).orderBy("nprobe").collect()
    recalls = [r["recall"] for r in rows]
    assert [r["nprobe"] for r in rows] == [4, 8, 12] and recalls == sorted(recalls)
    assert recalls[-1] >= 0.9


def test_codes_rank_like_vectors(data):
    corpus, _, m, q, names = data
    good = corpus.where("id like 'd%'")
    lo, hi = vectors.sq8_ranges(good)
    coded = vectors.sq8_quantize(good, lo, hi)
    assert dict(coded.dtypes)["codes"] == "array<tinyint>"
    got = [r["id"] for r in vectors.sq8_topk(coded, list(q[3]), lo, hi, 5, widen=50).collect()]
    assert got == brute(m, q, names, 5)[3]
    worst = coded.select(F.array_min("codes").alias("a"), F.array_max("codes").alias("b")).agg(F.min("a"), F.max("b")).first()
    assert tuple(worst) == (-128, 127)


def test_hashed_embedding_is_unit_and_repeatable(spark):
    rows = en.needs_embedding(fx.processed(spark, SMALL))
    a = vectors.embed(rows, generated_at=F.lit("t")).select("id", "embedding", "is_ai_ready", "embedding_dimensions")
    got = a.collect()
    assert len(got) == rows.count() and all(r["is_ai_ready"] and r["embedding_dimensions"] == 256 for r in got)
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in got)
    again = {r["id"]: r["embedding"] for r in a.collect()}
    assert all(again[r["id"]] == r["embedding"] for r in got)


def test_failed_calls_leave_rows_not_ready(make):
    rows = en.enrich(make({"id": "good"}, {"id": "none"}))
    some = vectors.embed(rows, lambda texts: [None if "none" in t else [1.0, 2.0] for t in texts], model="m")
    got = {r["id"]: r for r in some.collect()}
    assert got["good"]["is_ai_ready"] and got["good"]["embedding"] == [1.0, 2.0] and got["good"]["embedding_model"] == "m"
    assert not got["none"]["is_ai_ready"] and got["none"]["embedding_model"] is None

    def broken(texts):
        raise RuntimeError("down")
    assert {r["is_ai_ready"] for r in vectors.embed(rows, broken).collect()} == {False}


def test_one_bad_text_costs_no_other_row(make):
    rows = en.enrich(make(*[{"id": f"d{i}" if i != 7 else "bad"} for i in range(20)])).coalesce(1)

    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[1.0] for _ in texts]
    got = {r["id"]: r["is_ai_ready"] for r in vectors.embed(rows, picky).collect()}
    assert [k for k, ready in got.items() if not ready] == ["bad"] and len(got) == 20


def test_queries_of_several_widths(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0, 0.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0, 0.2]), (3, []), (4, None)], "query_id int, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.topk_batch(queries, corpus, 2).collect()}
    assert got == {(1, 1): "a", (1, 2): "b", (2, 1): "c"}
    tiled = {(r["query_id"], r["rank"]): r["id"] for r in vectors.topk_batch(queries, corpus, 2, max_values=0).collect()}
    assert tiled == got


def test_equal_vectors_are_measured_once(spark, data):
    """Each distinct vector is one row of the search, with its smallest ids; the hits are those of the whole corpus."""
    corpus, queries, m, q, names = data
    copies = corpus.where("id like 'd%'").select(F.explode(F.array([F.lit(c) for c in "abc"])).alias("c"), "id", "embedding").select(
        F.concat("id", "c").alias("id"), "embedding")
    held = vectors.by_vector(copies, 5).collect()
    assert len(held) == len(np.unique(m, axis=0)) == 401 and max(len(r["ids"]) for r in held) == 5
    common = next(r for r in held if "d0000a" in r["ids"])
    assert sorted(common["ids"]) == ["d0000a", "d0000b", "d0000c", "d0003a", "d0003b"]
    found = vectors.topk_batch(queries, copies, 5)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text[text.index("MapInArrow"):]
    many = [n + c for n in names for c in "abc"]
    assert lists(found) == brute(np.repeat(m, 3, axis=0), q, many, 5)


def test_centres_are_fitted_on_weighted_vectors(spark):
    """Copies of a vector are one weighted point, not rows that tasks hold."""
    corpus = spark.createDataFrame([(f"{i}", [1.0, 0.0] if i % 4 else [0.0, float(i % 8 + 1)]) for i in range(80)], "id string, embedding array<float>")
    model = vectors.train_cells(corpus, 2)
    assert sorted(model.summary.clusterSizes) == [1, 2]
    assert {tuple(np.round(c, 6)) for c in model.clusterCenters()} == {(1.0, 0.0), (0.0, 1.0)}
