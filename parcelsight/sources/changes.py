"""Keyed state from append-only change logs: last write wins, deletes remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPSERT, DELETE = "U", "D"


def _newest_row(df: DataFrame, order: list[str]) -> Column:
    # rows that tie in `order` are told apart by their content, so that every run keeps the same one
    return F.max_by(F.struct(*df.columns), F.struct(*order, F.xxhash64(*df.columns))).alias("row")


def upsert_latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row per key. Each task first reduces its own changes to one row per key, so a key
    that changes all the time costs one row per task."""
    return changes.groupBy(F.col(key).alias("_key")).agg(_newest_row(changes, order)).select("row.*")


def as_changes(df: DataFrame, op: str = UPSERT) -> DataFrame:
    return df.withColumn("op", F.lit(op))


def current_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """State of a change log: keys whose newest entry is not a delete."""
    return upsert_latest(log, key, order).where(F.col("op") != DELETE).drop("op")


def compact(log: DataFrame, key: str, order: list[str], path: str) -> None:
    """Write the newest entry of every key as a snapshot that can stand in for the log so far. Deletes stay
    in it with their order, so that an older change that comes late does not bring a row back."""
    upsert_latest(log, key, order).write.mode("overwrite").parquet(path)


def apply_deletes(processed: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """Processed rows whose raw row was not deleted; a tombstone without a row does nothing."""
    return processed.join(tombstones.select(key), key, "left_anti")


def merge_changes(current: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Old state and new changes to new state; running it twice changes nothing."""
    return current_rows(as_changes(current).unionByName(changes, allowMissingColumns=True), key, order)


def route_by_collection(mixed: DataFrame, collection: str, schema) -> DataFrame:
    """The documents of one collection out of a mixed (collection, key, value) frame; those that are
    no JSON are left to `unroutable`."""
    rows = mixed.where((F.col("collection") == collection) & _is_json())
    return rows.select(F.from_json("value", schema).alias("doc")).select("doc.*")


def _is_json() -> Column:
    return F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False))


def unroutable(mixed: DataFrame, collections: list[str] | tuple[str, ...]) -> DataFrame:
    """What no collection takes, as it came, with the `reason`: an unknown collection or a malformed value."""
    known = F.coalesce(F.col("collection").isin(*collections), F.lit(False))
    reason = F.when(~known, F.lit("unknown collection")).when(~_is_json(), F.lit("malformed value"))
    return mixed.withColumn("reason", reason).where(F.col("reason").isNotNull())


def as_documents(df: DataFrame, collection: str, key: str = "id") -> DataFrame:
    return df.select(F.lit(collection).alias("collection"), F.col(key).alias("key"),
                     F.to_json(F.struct(*df.columns)).alias("value"))
