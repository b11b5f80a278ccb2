"""Headline timings. Prints one JSON line.

The collections are first written as tables, as they would lie on a cluster; each query then reads
those tables. A query's time is the better of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from parcelsight.operators import enrich as en  # noqa: E402
from parcelsight.operators import episodes, feeds, joins, metrics, rag, sensors, vectors  # noqa: E402
from parcelsight.plans import fixtures as fx  # noqa: E402
from parcelsight.session import build_session, scratch_dir  # noqa: E402
from parcelsight.sources import changes, readers  # noqa: E402
from parcelsight.streaming import jobs  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    root = scratch_dir(spark, "bench")
    times: dict[str, float] = {}

    def timed(name: str, run, repeat: int = 2) -> None:
        best = None
        for _ in range(repeat):
            start = time.perf_counter()
            run()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)

    def stored(name: str, df: DataFrame) -> DataFrame:
        path = f"{root}/{name}"
        start = time.perf_counter()
        df.write.mode("overwrite").parquet(path)
        times[f"load_{name}"] = round(time.perf_counter() - start, 3)
        return spark.read.parquet(path)

    raw = stored("deliveries", fx.deliveries(spark, SF_DIR))
    events = stored("events", fx.events(spark, SF_DIR))
    homes = stored("homes", fx.homes(spark, SF_DIR))
    alerts = stored("alerts", episodes.derive_alerts(raw))
    processed = stored("processed", en.enrich(raw, F.lit("2024-01-01T00:00:00.000Z")))
    vecs = fx.table(spark, SF_DIR, "embeddings")
    ready = stored("ready", processed.join(vecs.select("vec_id", "embedding"), "vec_id")
                   .withColumn("is_ai_ready", F.lit(True)))
    counts = {n: df.count() for n, df in (("deliveries", raw), ("events", events), ("alerts", alerts),
                                          ("processed", processed))}
    question = vecs.orderBy("vec_id").first()["embedding"]
    questions = vecs.select(F.col("vec_id").alias("query_id"), "embedding")

    # ingest of every document through the mixed stream
    docs = changes.as_documents(raw.drop("vec_id", "street"), "deliveries").unionByName(
        changes.as_documents(alerts, "alerts")).unionByName(
        changes.as_documents(events.drop("delivery_id", "event_ts"), "events"))
    stored("mixed", docs)

    def ingest():
        run = scratch_dir(spark, "bench-ingest")
        feed = readers.stream_raw(spark, "mixed", f"{root}/mixed")
        jobs.start_routing(feed, run, f"{run}/state").awaitTermination()

    def streamed():
        run = scratch_dir(spark, "bench-stream")
        feed = spark.readStream.schema(raw.schema).parquet(f"{root}/deliveries")
        jobs.start_enrichment(feed, f"{run}/processed", f"{run}/state").awaitTermination()

    timed("ingest_documents", ingest)
    timed("streamed_enrichment", streamed)
    timed("enrich", lambda: drain(en.enrich(raw)))
    timed("embed", lambda: drain(vectors.embed(en.needs_embedding(processed), dim=256)))
    timed("assemble_deliveries", lambda: drain(episodes.assemble_deliveries(events)))
    timed("derive_alerts", lambda: drain(episodes.derive_alerts(raw)))
    timed("classify_scenario", lambda: drain(episodes.classify_scenario(events)))
    timed("upsert_latest", lambda: drain(changes.upsert_latest(
        raw.unionByName(raw.withColumn("updated_at", F.lit("2999-01-01T00:00:00Z"))), "id", ["updated_at"])))
    timed("lookup_by_id", lambda: joins.lookup_by_id(processed, ["del-00000001"]).collect())
    timed("recent_raw", lambda: feeds.recent_raw(raw).collect())
    timed("recent_processed", lambda: feeds.recent_processed(processed).collect())
    timed("balanced_alerts", lambda: feeds.balanced_alerts(alerts, 50).collect())
    timed("diverse_feed_per_home", lambda: drain(
        feeds.diverse_pick(feeds.recent_per_group(raw, "home_id"), 6, "home_id")))
    timed("delivery_cards", lambda: drain(feeds.delivery_cards(raw)))
    timed("redaction_audit", lambda: drain(joins.redaction_audit(raw, processed)))
    timed("processing_progress", lambda: metrics.processing_progress(raw, processed).collect())
    timed("fleet_overview", lambda: metrics.fleet_overview(homes, raw, alerts, ready).collect())
    timed("pattern_groups", lambda: metrics.pattern_groups(raw).collect())
    timed("door_dwell", lambda: drain(sensors.door_dwell(events)))
    live = fx.table(spark, SF_DIR, "events").select(
        F.col("ts").cast("timestamp").alias("ingest_ts"), F.lit("events").alias("collection"))
    timed("throughput", lambda: drain(metrics.throughput(metrics.tick_counts(live))))
    timed("filtered_topk", lambda: vectors.filtered_topk(ready, question, 10, risk_level="high").collect())
    timed("topk_batch", lambda: drain(vectors.topk_batch(questions, ready, 10)))
    index = vectors.index_rows(ready)
    built: dict = {}

    def build_cells():
        built["model"] = vectors.train_cells(index, 16)
        vectors.write_cells(vectors.assign_cells(index, built["model"]), f"{root}/cells")

    timed("build_cells", build_cells)
    cells = spark.read.parquet(f"{root}/cells")
    timed("ann_topk", lambda: vectors.ann_topk(cells, built["model"], question, 10).collect())
    hits = vectors.topk_batch(questions, ready, 8).join(ready.select(*feeds.SEARCH_RESULT), "id")
    timed("question_contexts", lambda: drain(rag.context(hits)))

    headline = {k: v for k, v in times.items() if not k.startswith("load_")}
    documents = counts["deliveries"] + counts["events"] + counts["alerts"]
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(headline.values()), 3), "unit": "sec",
        "queries": headline, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "load": {k[5:]: v for k, v in times.items() if k.startswith("load_")},
        "rates": {
            "documents_ingested_per_sec": round(documents / times["ingest_documents"]),
            "deliveries_enriched_per_sec": round(counts["deliveries"] / times["enrich"]),
            "deliveries_enriched_per_sec_streamed": round(counts["deliveries"] / times["streamed_enrichment"]),
            "deliveries_embedded_per_sec": round(counts["processed"] / times["embed"]),
        },
        "rows": counts}))


if __name__ == "__main__":
    main()
