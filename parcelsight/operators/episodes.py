"""Sensor events to deliveries, alerts and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelsight.functions.episode import (
    ALERT_OF_SCENARIO, alert_message, alert_severity, event_summary,
)
from parcelsight.functions.text import lookup

PART_EVENTS = 10_000


def assemble_deliveries(events: DataFrame, key: str = "delivery_id", part_events: int = PART_EVENTS) -> DataFrame:
    """Episodes with their ordered event ids and timeline, in numbered parts of at most `part_events` events.

    Parts of an episode are numbered from 0 without gaps, and all but the last are full; an episode that fits is one row.
    Events without an episode, home or time are parts of the missing one. An event's place is its rank within
    an hour plus the sizes of the hours before, so an episode with a third of all events is many small sorts.
    """
    some = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    hour = F.coalesce(F.substring(F.col("timestamp").cast("string"), 1, 13), F.lit(""))
    cells = ["_episode", "_home", "_hour"]
    celled = events.withColumns(dict(zip(cells, (some(key), some("home_id"), hour))))
    before = W.partitionBy("_episode", "_home").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    starts = celled.groupBy(*cells).agg(F.count("*").alias("n")).select(
        *cells, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    entry = F.struct(
        F.col("timestamp").alias("at"), F.col("id").alias("event_id"), F.col("type").alias("event_type"),
        "location")
    inside = W.partitionBy(*cells).orderBy("_entry")
    placed = (celled.select(key, "home_id", *cells, entry.alias("_entry")).join(starts, cells)
              .withColumn("part", F.floor((F.col("_start") + F.row_number().over(inside) - 1) / part_events).cast("int")))
    grouped = placed.groupBy(key, "home_id", "part").agg(F.array_sort(F.collect_list("_entry")).alias("entries"))
    timeline = F.transform("entries", lambda e: F.struct(
        e["event_id"].alias("event_id"), e["event_type"].alias("event_type"),
        e["location"].alias("location"),
        event_summary(e["event_type"], e["location"]).alias("summary"), e["at"].alias("timestamp")))
    return grouped.select(
        key, "home_id", "part", F.transform("entries", lambda e: e["event_id"]).alias("event_ids"),
        timeline.alias("event_timeline"), F.size("entries").alias("n_events"))


def derive_alerts(deliveries: DataFrame) -> DataFrame:
    """At most one alert per delivery. The message names the street, the first part of the address."""
    kind = lookup(F.col("scenario_type"), ALERT_OF_SCENARIO)
    street = F.substring_index("address", ", ", 1)
    return (deliveries.withColumn("alert_type", kind).where(F.col("alert_type").isNotNull())
            .select(
                F.replace(F.col("id"), F.lit("del-"), F.lit("alert-")).alias("id"),
                F.col("id").alias("delivery_id"), "home_id", "address", "alert_type",
                alert_severity(F.col("alert_type")).alias("severity"),
                alert_message(F.col("alert_type"), street).alias("message"),
                F.col("created_at").alias("triggered_at"),
                F.lit(False).alias("acknowledged"),
                F.col("event_ids").alias("related_event_ids")))


def scenario_marks() -> dict:
    """Constant-size evidence per episode, kept by map-side aggregates."""
    kind, place = F.col("type"), F.col("location")
    package = kind == "package_detected"
    evidence = {
        "theft_suspicious": kind == "unknown_person",
        "door_stuck_open": kind == "door_stuck",
        "no_package_placed": kind == "package_not_detected",
        "delivery_timeout": kind == "delivery_timeout",
        "package_behind_car": package & (place == "behind_vehicle"),
        "happy_path": kind == "delivery_confirmed",
        "front_door_misdelivery": package & (place == "front_door"),
    }
    return {name: F.bool_or(F.coalesce(test, F.lit(False))) for name, test in evidence.items()}


def inferred_scenario() -> Column:
    """First mark that holds, in order of how telling it is."""
    return F.coalesce(*[F.when(F.col(f"saw_{name}"), name) for name in scenario_marks()])


def classify_scenario(events: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("delivery_id",)
    marks = [mark.alias(f"saw_{name}") for name, mark in scenario_marks().items()]
    seen = events.groupBy(*keys).agg(F.count("*").alias("n_events"), *marks)
    return seen.select(*keys, "n_events", inferred_scenario().alias("scenario_type"))


def _session_columns(first: str, last: str) -> list:
    return ["home_id", first, last, "n_events", inferred_scenario().alias("scenario_type")]


def session_episodes(events: DataFrame, gap_seconds: int = 3 * 3600, ts: str = "event_ts") -> DataFrame:
    """Episodes found by quiet gaps per home.

    Events of one home inside one gap-long slice of time always belong together, so slices are
    aggregated first (map-side) and only their ends are compared: a home with a third of all events
    brings one row per slice to the window.
    """
    names = list(scenario_marks())
    slices = (events.where(F.col(ts).isNotNull())
              .groupBy("home_id", F.floor(F.unix_timestamp(ts) / gap_seconds).alias("slice"))
              .agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"),
                   *[mark.alias(f"saw_{name}") for name, mark in scenario_marks().items()]))
    in_order = W.partitionBy("home_id").orderBy("slice")
    quiet = F.unix_micros("first") - F.unix_micros(F.lag("last").over(in_order)) > gap_seconds * 1_000_000
    numbered = (slices.withColumn("opens", F.coalesce(quiet, F.lit(True)))
                .withColumn("session", F.count_if("opens").over(in_order)))
    sessions = numbered.groupBy("home_id", "session").agg(
        F.sum("n").alias("n_events"), F.min("first").alias("first_event"), F.max("last").alias("last_event"),
        *[F.bool_or(f"saw_{name}").alias(f"saw_{name}") for name in names])
    return sessions.select(*_session_columns("first_event", "last_event"))


def live_sessions(events: DataFrame, gap: str = "3 hours", ts: str = "event_ts") -> DataFrame:
    """The same on a stream (set a watermark). A session's state is counts, ends and marks, never its
    events, so a home that is never quiet keeps one small row."""
    marks = [mark.alias(f"saw_{name}") for name, mark in scenario_marks().items()]
    seen = events.groupBy(F.session_window(ts, gap).alias("session"), "home_id").agg(
        F.count("*").alias("n_events"), F.min(ts).alias("first_event"), F.max(ts).alias("last_event"), *marks)
    return seen.select(*_session_columns("first_event", "last_event"))
