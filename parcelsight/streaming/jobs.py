"""Streaming jobs. Each is a batch operator on a stream plus a sink with its own checkpoint.

The parquet sink writes every micro-batch once, also when an executor or the driver is lost and the
batch runs again. Tables written this way are append-only change logs; see sources.changes for the
state they stand for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelsight import schemas
from parcelsight.functions.text import iso_time
from parcelsight.operators import vectors
from parcelsight.operators.enrich import enrich, needs_embedding, reject_bad_rows
from parcelsight.operators.episodes import live_sessions
from parcelsight.operators.metrics import tick_counts
from parcelsight.sources.changes import route_by_collection, unroutable, upsert_latest

NOW = {"availableNow": True}


def append_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or NOW)).start())


# ---- raw to processed to AI-ready ---------------------------------------------------------------

def start_enrichment(raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                     processed_at=None) -> StreamingQuery:
    return append_table(enrich(raw, processed_at), path, checkpoint, trigger)


def start_rejects(raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return append_table(reject_bad_rows(raw), path, checkpoint, trigger)


def start_embedding(processed: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                    **how) -> StreamingQuery:
    """Second stage. Its input is the processed log and its output another log, so a row it wrote
    does not come back to it, and a re-enriched row does."""
    return append_table(vectors.embed(needs_embedding(processed), **how), path, checkpoint, trigger)


# ---- one mixed stream to several tables ---------------------------------------------------------

def start_routing(mixed: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                  collections: tuple[str, ...] = ("events", "deliveries", "alerts")) -> StreamingQuery:
    """Split (collection, key, value) documents into one table per collection; what none takes goes to `rejected`.

    A micro-batch lands in folders named after its number and is overwritten when it runs again, so
    a repeat after a failure leaves no second copy. Its documents are not kept in memory: every table reads its own
    collection from the source, where the filter skips the files and row groups of the others.
    """
    def route(batch: DataFrame, number: int) -> None:
        for name in collections:
            (route_by_collection(batch, name, schemas.RAW[name])
             .write.mode("overwrite").parquet(f"{root}/{name}/batch={number}"))
        unroutable(batch, collections).write.mode("overwrite").parquet(f"{root}/rejected/batch={number}")

    return (mixed.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or NOW)).start())


def start_upserts(changes: DataFrame, root: str, checkpoint: str, key: str, order: list[str],
                  trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch to the change log, already reduced to its newest row per key."""
    def write(batch: DataFrame, number: int) -> None:
        upsert_latest(batch, key, order).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return (changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or NOW)).start())


# ---- throughput ---------------------------------------------------------------------------------

def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermark on a real timestamp column; a timestamp without zone is read in the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def stream_ticks(mixed: DataFrame, ts: str = "ingest_ts", late: str = "10 seconds",
                 tick: str = "1 second") -> DataFrame:
    """Closed ticks only: a tick is final once the watermark has passed it, later rows are dropped."""
    return tick_counts(timed(mixed, ts, late), ts, tick)


def start_metrics(mixed: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                  **when) -> StreamingQuery:
    """Append one row per closed tick; operators.metrics.throughput turns them into running totals."""
    return append_table(stream_ticks(mixed, **when), path, checkpoint, trigger)


def metrics_documents(throughput: DataFrame, target_rate: int, workers: int, batch_size: int,
                      running: bool = True) -> DataFrame:
    """Throughput rows in the shape of the metrics document, one per tick."""
    start = F.timestamp_seconds(F.unix_timestamp("tick") - F.col("elapsed_seconds").cast("bigint") + 1)
    return throughput.select(
        "total_events_ingested", "total_deliveries", "total_alerts",
        F.lit(target_rate).alias("target_rate"), "actual_rate", iso_time(start).alias("start_time"),
        iso_time(F.col("tick")).alias("last_update"), F.lit(running).alias("running"), "elapsed_seconds",
        F.lit(workers).alias("workers"), F.lit(batch_size).alias("batch_size"))


def stream_sessions(events: DataFrame, gap: str = "3 hours", late: str = "10 minutes",
                    ts: str = "event_ts") -> DataFrame:
    return live_sessions(timed(events, ts, late), gap, ts)
