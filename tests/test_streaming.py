"""Streams give what the batch gives, start again without repeats, and drop what is too late."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures_small import SMALL
from parcelsight import schemas
from parcelsight.operators import enrich as en
from parcelsight.operators import episodes, metrics, vectors
from parcelsight.plans import fixtures as fx
from parcelsight.sources import changes, readers
from parcelsight.streaming import jobs

STAMP = "2024-01-01T00:00:00.000Z"


@pytest.fixture(scope="module")
def raw(spark):
    return fx.deliveries(spark, SMALL).drop("vec_id", "street").cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_enrichment_stream_equals_batch_and_restarts(spark, raw, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    raw.where("id < 'del-00000700'").repartition(3).write.parquet(src)
    run = lambda: jobs.start_enrichment(readers.stream_raw(spark, "deliveries", src, max_files=1), out, state,
                                        processed_at=F.lit(STAMP)).awaitTermination()
    run(), run()
    raw.where("id >= 'del-00000700'").write.mode("append").parquet(src)
    run(), run()
    assert same(spark.read.parquet(out), en.enrich(raw, F.lit(STAMP)))


def test_rejects_stream(spark, raw, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    raw.withColumn("delivery_location", F.nullif("delivery_location", F.lit("unknown"))).write.parquet(src)
    jobs.start_rejects(readers.stream_raw(spark, "deliveries", src), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == en.pending_only(raw).where("delivery_location = 'unknown'").count() > 0


def test_two_stages_and_a_changed_delivery(spark, make, tmp_path):
    src, done, ready = (str(tmp_path / n) for n in ("in", "processed", "ready"))

    def step(stamp):
        jobs.start_enrichment(readers.stream_raw(spark, "deliveries", src), done, str(tmp_path / "s1"),
                              processed_at=F.lit(stamp)).awaitTermination()
        log = spark.readStream.schema(schemas.PROCESSED).parquet(done)
        jobs.start_embedding(log, ready, str(tmp_path / "s2")).awaitTermination()

    make({"id": "a"}, {"id": "b"}).write.parquet(src)
    step("t1"), step("t1")
    assert spark.read.parquet(ready).count() == 2
    make({"id": "a", "status": "failed"}).write.mode("append").parquet(src)
    step("t2")
    log = spark.read.parquet(ready)
    assert log.count() == 3
    state = {r["id"]: r for r in changes.upsert_latest(log, "id", ["processed_at"]).collect()}
    assert state["a"]["status"] == "failed" and state["a"]["is_ai_ready"] and len(state) == 2
    assert list(state["a"]["embedding"]) != list(state["b"]["embedding"])


def test_routing_repeats_leave_one_copy(spark, raw, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    docs = changes.as_documents(raw, "deliveries").unionByName(
        changes.as_documents(episodes.derive_alerts(raw), "alerts"))
    docs.write.parquet(src)
    feed = lambda: readers.stream_raw(spark, "mixed", src)
    jobs.start_routing(feed(), root, str(tmp_path / "s")).awaitTermination()
    # a second start from scratch stands for a batch that runs again after a crash before its commit
    jobs.start_routing(feed(), root, str(tmp_path / "s-again")).awaitTermination()
    back = spark.read.schema(schemas.DELIVERY).parquet(f"{root}/deliveries").drop("batch")
    assert same(back, raw)
    assert spark.read.parquet(f"{root}/alerts").count() == episodes.derive_alerts(raw).count()
    assert spark.read.schema(schemas.EVENT).parquet(f"{root}/events").count() == 0


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def feed_rows(spark, path, rows, mode="append"):
    spark.createDataFrame([(at(s), c) for s, c in rows], "ingest_ts timestamp_ntz, collection string") \
         .coalesce(1).write.mode(mode).parquet(path)


def test_ticks_drop_late_rows_and_close(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "ticks", "state"))
    stream = lambda: spark.readStream.schema("ingest_ts timestamp_ntz, collection string").parquet(src)
    run = lambda: jobs.start_metrics(stream(), out, state, late="10 seconds").awaitTermination()
    feed_rows(spark, src, [(0, "events"), (0, "events"), (1, "deliveries"), (30, "events")])
    run()
    feed_rows(spark, src, [(0, "events"), (25, "alerts"), (60, "events")])     # second 0 is closed by now
    run()
    got = {r["tick"].second: (r["events"], r["deliveries"], r["alerts"]) for r in spark.read.parquet(out).collect()}
    assert got == {0: (2, 0, 0), 1: (0, 1, 0), 25: (0, 0, 1), 30: (1, 0, 0)}
    docs = jobs.metrics_documents(metrics.throughput(spark.read.parquet(out)), 5000, 50, 200)
    last = docs.orderBy(F.desc("last_update")).first()
    assert docs.columns == schemas.METRICS.names
    assert (last["total_events_ingested"], last["total_deliveries"], last["total_alerts"]) == (3, 1, 1)
    assert last["start_time"] == "2024-01-01T00:00:00Z" and last["elapsed_seconds"] == 31.0


def test_live_sessions_equal_batch_sessions(spark, tmp_path):
    events = fx.events(spark, SMALL)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.select("home_id", "event_ts", "type", "location").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    jobs.append_table(jobs.stream_sessions(stream, "5 hours"), out, str(tmp_path / "s")).awaitTermination()
    live = spark.read.parquet(out)
    assert same(episodes.live_sessions(events, "5 hours"), episodes.session_episodes(events, 5 * 3600))
    assert live.exceptAll(episodes.session_episodes(events, 5 * 3600)).isEmpty() and live.count() > 1000


def test_embedding_stream_equals_batch(spark, raw, tmp_path):
    done = en.enrich(raw, F.lit(STAMP))
    done.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.PROCESSED).parquet(str(tmp_path / "in"))
    jobs.start_embedding(stream, str(tmp_path / "out"), str(tmp_path / "s"), generated_at=F.lit(STAMP)).awaitTermination()
    batch = vectors.embed(en.needs_embedding(done), generated_at=F.lit(STAMP))
    pick = lambda df: df.select("id", "is_ai_ready", F.hash("embedding").alias("h"), "embedding_model")
    assert same(pick(spark.read.parquet(str(tmp_path / "out"))), pick(batch))


def test_state_of_the_second_stage_leaves_vectors_out(spark):
    rows = __import__("__spark_entry__").queries()["streamed_two_stage"](spark, SMALL)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "embedding:array" not in text and "embedding_text" not in text and rows.columns[0] == "id"


def test_routing_keeps_no_batch_in_memory(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    kept = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *level: kept.append(level) or self)
    rows = __import__("__spark_entry__").queries()["routed_collections"](spark, SMALL)
    assert rows.groupBy("collection").count().count() == 3 and not kept


def test_sessions_are_fed_from_files_of_bounded_rows(spark, monkeypatch, tmp_path):
    from parcelsight.plans import queries
    monkeypatch.setattr(queries, "EVENTS_PER_FILE", 500)
    monkeypatch.setattr(queries, "scratch_dir", lambda session, label: str(tmp_path / label))
    assert queries.streamed_sessions(spark, SMALL).count() > 0
    sizes = spark.read.parquet(str(tmp_path / "sessions/in")).groupBy(F.input_file_name()).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] == 500 and sizes[1] > 8
