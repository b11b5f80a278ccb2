"""Layout of stored collections, chosen for the queries that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Per collection the time column that orders its feeds and the column it is filtered by.
LAYOUT = {
    "deliveries": ("created_at", "status"),
    "processed": ("created_at", "status"),
    "alerts": ("triggered_at", "severity"),
    "events": ("timestamp", "home_id"),
}

JSON_ROWS = 100_000     # documents per file: compressed lines cannot be split, so this bounds a task's share


def write_json(df: DataFrame, path: str) -> None:
    """Compressed JSON lines in files of bounded size; `readers.read_raw` reads them as they are."""
    df.write.option("maxRecordsPerFile", JSON_ROWS).json(path, compression="gzip")


def write_by_day(df: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """One folder per day; inside a file rows are ordered by filter column and time, so that filters
    and time bounds skip row groups, and ids carry a bloom filter for point lookups.

    The rebalance hint lets AQE cut a busy day into several files and join quiet days.
    """
    ts, sought = LAYOUT[kind]
    dated = df.withColumn("day", F.left(F.col(ts), F.lit(10)))
    (dated.hint("rebalance", "day").sortWithinPartitions("day", sought, ts)
     .write.mode(mode).partitionBy("day")
     .option("parquet.bloom.filter.enabled#id", "true")
     .parquet(path))
