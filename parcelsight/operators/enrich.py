"""Raw delivery to processed delivery, and processed delivery to AI-ready delivery (selection)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.narrative import embedding_text, knowledge_summary, risk_assessment
from parcelsight.functions.text import iso_time, redact_name

ENRICHMENT_VERSION = "2.0"
SOURCE_SCOPE = "rawdata"
MIN_EMBED_CHARS = 10
EMBEDDING_COLUMNS = ("embedding", "embedding_model", "embedding_dimensions", "embedding_generated_at")


def iso_now() -> Column:
    return iso_time(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def pending_only(deliveries: DataFrame) -> DataFrame:
    return deliveries.where(F.col("processing_status") == "pending")


def reject_reason() -> Column:
    """Why a pending row cannot be enriched; null when it can."""
    holes = F.exists(F.coalesce(F.col("event_timeline"), F.array()), lambda e: e.isNull())
    return (F.when(F.col("delivery_location").isNull(), "delivery_location is null")
            .when(holes, "event_timeline has a null entry"))


def reject_bad_rows(deliveries: DataFrame) -> DataFrame:
    """The pending rows that enrichment leaves out, whole, each with its reason."""
    return (pending_only(deliveries).withColumn("reject_reason", reject_reason())
            .where(F.col("reject_reason").isNotNull()))


def enrich(deliveries: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Enrich pending deliveries. Row by row, so it runs on batch and streaming frames alike.

    The output row is rebuilt from the raw row: embedding columns that an earlier run had added do
    not survive a change of the delivery.
    """
    rows = pending_only(deliveries).where(reject_reason().isNull()).drop(*EMBEDDING_COLUMNS)
    redacted = rows.withColumn("owner_name", redact_name(F.col("owner_name")))
    told = redacted.withColumns({
        "knowledge_summary": knowledge_summary(F.col("owner_name")),
        "risk_assessment": risk_assessment(F.col("risk_score"), F.col("risk_factors")),
        "processing_status": F.lit("processed"),
        "processed_at": iso_now() if processed_at is None else processed_at,
        "is_ai_ready": F.lit(False),
        "enrichment_version": F.lit(ENRICHMENT_VERSION),
        "source_scope": F.lit(SOURCE_SCOPE),
        "pii_redacted": F.lit(True),
    })
    return told.withColumn(
        "embedding_text", embedding_text(F.col("knowledge_summary"), F.col("risk_assessment.level")))


def text_to_embed() -> Column:
    return F.coalesce(F.nullif(F.col("embedding_text"), F.lit("")),
                      F.nullif(F.col("knowledge_summary"), F.lit("")), F.lit(""))


def needs_embedding(processed: DataFrame) -> DataFrame:
    ready = F.coalesce(F.col("is_ai_ready"), F.lit(False))
    bare = F.lit(True)
    if "embedding" in processed.columns:
        bare = F.coalesce(F.array_size("embedding"), F.lit(0)) == 0
    # a generator of one element: the filter on the text does not pull the making of the text into it, so it is made once
    rows = processed.select("*", F.explode(F.array(text_to_embed())).alias("_text_to_embed"))
    return rows.where(~ready & (F.col("processing_status") == "processed") & bare
                      & (F.length("_text_to_embed") >= MIN_EMBED_CHARS)).drop("_text_to_embed")
