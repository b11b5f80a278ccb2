"""Relations between the collections.

Joins on unique keys are left to AQE, which broadcasts a side only after measuring it. Joins on a key
that may be hot go through `balanced_join`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.episode import full_address
from parcelsight.functions.text import REDACTED
from parcelsight.operators.skew import balanced_join

MAX_LITERAL_IDS = 1000


def redaction_audit(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Every raw delivery beside its processed twin, and whether the raw name shows in the twin."""
    left = raw.select("id", "created_at", F.col("owner_name").alias("raw_name"),
                      F.col("address").alias("raw_address"))
    right = processed.select(
        "id", F.col("owner_name").alias("shown_name"), F.col("address").alias("shown_address"),
        "knowledge_summary", "embedding_text", F.lit(True).alias("has_twin"))
    joined = left.join(right, "id", "left")
    texts = [F.coalesce(F.contains(F.col(c), F.col("raw_name")), F.lit(False))
             for c in ("shown_name", "knowledge_summary", "embedding_text")]
    named = F.coalesce(F.col("raw_name"), F.lit("")) != ""
    return joined.select(
        "id", "created_at", F.coalesce("raw_name", F.lit("N/A")).alias("raw_name"),
        F.coalesce("raw_address", F.lit("N/A")).alias("raw_address"),
        F.coalesce("shown_name", F.lit(REDACTED)).alias("shown_name"),
        F.coalesce("shown_address", F.lit("N/A")).alias("shown_address"),
        F.coalesce("has_twin", F.lit(False)).alias("has_twin"),
        (named & (texts[0] | texts[1] | texts[2])).alias("name_leaked"),
    )


def attach_home(deliveries: DataFrame, homes: DataFrame) -> DataFrame:
    """Home facts onto each delivery; a home with very many deliveries is shared out over tasks."""
    facts = homes.select(
        F.col("id").alias("home_id"), F.col("owner_name").alias("home_owner"),
        full_address(F.col("address"), F.col("city"), F.col("state"), F.col("zip_code"))
        .alias("home_address"),
        F.col("address").alias("home_street"), "latitude", "longitude", "devices")
    return balanced_join(deliveries, facts, "home_id", spread="id")


def explode_delivery_events(deliveries: DataFrame) -> DataFrame:
    """One row per timeline entry, from the embedded array: raw event ids are not unique."""
    return deliveries.select(
        F.col("id").alias("delivery_id"), "home_id",
        F.posexplode("event_timeline").alias("pos", "event"),
    ).select("delivery_id", "home_id", "pos", "event.*")


def unprocessed(raw: DataFrame, processed: DataFrame) -> DataFrame:
    return raw.join(processed.select("id"), "id", "left_anti")


def alert_context(alerts: DataFrame, deliveries: DataFrame) -> DataFrame:
    facts = deliveries.select(
        F.col("id").alias("delivery_id"), "scenario_type", "status", "carrier", "risk_score",
        "delivery_location")
    return balanced_join(alerts, facts, "delivery_id", spread="id")


def lookup_by_id(df: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Rows with the given keys; an absent key gives no row.

    A short list becomes a predicate that reaches the scan; a long list or a frame a semi join.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select("id").distinct(), "id", "left_semi")
    if len(ids) <= MAX_LITERAL_IDS:
        return df.where(F.col("id").isin(list(ids)))
    wanted = df.sparkSession.createDataFrame([(i,) for i in set(ids)], "id string")
    return df.join(wanted, "id", "left_semi")
