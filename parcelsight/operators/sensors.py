"""Sensor rollups and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelsight.functions.episode import pick_device
from parcelsight.operators.joins import attach_home
from parcelsight.operators.metrics import steady_mean
from parcelsight.operators.skew import balanced_join

DOOR_EVENTS = ("door_open", "door_close", "door_stuck")
GRID = 0.05


def assign_devices(events: DataFrame, homes: DataFrame) -> DataFrame:
    """The device of the home that reports from the event's place."""
    devices = homes.select(F.col("id").alias("home_id"), "devices")
    return (balanced_join(events, devices, "home_id", spread="id")
            .withColumn("device_id", pick_device(F.col("devices"), F.col("location"))).drop("devices"))


def sensor_rollup(events: DataFrame) -> DataFrame:
    raw = F.col("raw_data")
    return events.groupBy("home_id", "device_id").agg(
        F.count("*").alias("events"),
        steady_mean(raw["motion_confidence"]).alias("mean_motion"),
        steady_mean(raw["classification_confidence"]).alias("mean_classification"),
        steady_mean(raw["signal_strength"]).alias("mean_signal"),
        F.max(raw["firmware_version"]).alias("firmware"))


def with_next(df: DataFrame, key: str, ts: str, tie: str, *wanted: str, unit: str = "day") -> DataFrame:
    """Adds `next`, a struct of (ts, tie, wanted…) of the following row with the same key.

    The following row is sought inside the time slice of the row; only the last row of a slice looks
    at the head of the next slice that has rows. A key with a third of all rows is thus sorted slice
    by slice in many tasks, and the window over whole keys sees one row per slice. `unit` is the
    length of a slice, as for date_trunc.
    """
    item = F.struct(ts, tie, *wanted)
    sliced = df.withColumn("slice", F.date_trunc(unit, ts))
    inside = W.partitionBy(key, "slice").orderBy(ts, tie)
    heads = sliced.groupBy(key, "slice").agg(F.min(item).alias("head"))
    following = heads.select(
        key, "slice", F.lead("head").over(W.partitionBy(key).orderBy("slice")).alias("next_head"))
    return (sliced.withColumn("next_inside", F.lead(item).over(inside))
            .join(following, [key, "slice"])
            .withColumn("next", F.coalesce("next_inside", "next_head"))
            .drop("slice", "next_inside", "next_head"))


def door_dwell(events: DataFrame) -> DataFrame:
    """Per home: door openings, those followed by a close, and the mean seconds until then."""
    doors = (events.where(F.col("type").isin(*DOOR_EVENTS))
             .select("home_id", "event_ts", F.col("id").alias("event_id"), "type"))
    opened = with_next(doors, "home_id", "event_ts", "event_id", "type").where(
        F.col("type") == "door_open")
    closed = F.coalesce(F.col("next.type") == "door_close", F.lit(False))
    seconds = F.unix_timestamp("next.event_ts") - F.unix_timestamp("event_ts")
    return opened.groupBy("home_id").agg(
        F.count("*").alias("opened"), F.count_if(closed).alias("closed"),
        F.avg(F.when(closed, seconds)).alias("mean_open_seconds"))


def geo_tag(deliveries: DataFrame, homes: DataFrame, grid: float = GRID) -> DataFrame:
    placed = attach_home(deliveries, homes)
    return placed.withColumns({
        "lat_cell": F.floor(F.col("latitude") / grid), "lon_cell": F.floor(F.col("longitude") / grid)})


def deliveries_per_cell(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("lat_cell", "lon_cell").agg(F.count("*").alias("deliveries"),
                                                      steady_mean(F.col("risk_score")).alias("mean_risk"))
