"""Typed reads of the raw collections, as tables and as streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from parcelsight import schemas

CORRUPT = "_corrupt_record"


def _schema(kind: str, fmt: str) -> StructType:
    schema = schemas.RAW[kind] if kind in schemas.RAW else {
        "processed": schemas.PROCESSED, "ai_ready": schemas.AI_READY, "mixed": schemas.MIXED}[kind]
    schema = StructType(list(schema.fields))
    return schema.add(CORRUPT, StringType()) if fmt == "json" else schema


def _timed(df: DataFrame, kind: str) -> DataFrame:
    """Events keep their timestamp text and gain it as a real timestamp."""
    return df.withColumn("event_ts", F.try_to_timestamp("timestamp")) if kind == "events" else df


def read_raw(spark: SparkSession, kind: str, path: str, fmt: str = "json") -> DataFrame:
    """Read homes, events, deliveries or alerts. Malformed JSON lines are kept in _corrupt_record."""
    reader = spark.read.schema(_schema(kind, fmt))
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return _timed(reader.format(fmt).load(path), kind)


def flush_policy(max_files: int | None = None, every: str | None = None,
                 available_now: bool = False) -> tuple[dict, dict]:
    """(reader options, trigger arguments): how much to take per write and how often to write."""
    options = {} if max_files is None else {"maxFilesPerTrigger": str(max_files)}
    if available_now:
        return options, {"availableNow": True}
    return options, {"processingTime": every or "100 milliseconds"}


def stream_raw(spark: SparkSession, kind: str, path: str, fmt: str = "parquet",
               max_files: int | None = None) -> DataFrame:
    """Change feed of a folder: all files that are there, then every new one."""
    options, _ = flush_policy(max_files, available_now=True)
    return _timed(spark.readStream.schema(_schema(kind, fmt)).options(**options).format(fmt).load(path), kind)


def try_read(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame | None:
    """A collection that may not be there yet; None when it cannot be read."""
    try:
        return read_raw(spark, kind, path, fmt)
    except AnalysisException:
        return None
