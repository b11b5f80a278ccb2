"""Explicit schemas of the collections. Timestamps are RFC3339 UTC text, so text order is time order."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields.items()])


def _strings(*names: str) -> dict:
    return {name: StringType() for name in names}


SENSOR = _struct(
    door_angle=DoubleType(), motion_confidence=DoubleType(), classification_label=StringType(),
    classification_confidence=DoubleType(), signal_strength=DoubleType(), firmware_version=StringType(),
)
EVENT = _struct(
    **_strings("id", "type", "home_id", "device_id", "timestamp", "location"), raw_data=SENSOR,
)
TIMELINE_ENTRY = _struct(**_strings("event_id", "event_type", "location", "summary", "timestamp"))
DELIVERY = _struct(
    **_strings("id", "home_id", "address", "owner_name", "status", "scenario_type", "carrier",
               "expected_window_start", "expected_window_end", "actual_delivery_time",
               "delivery_location"),
    event_ids=ArrayType(StringType()), event_timeline=ArrayType(TIMELINE_ENTRY),
    risk_score=DoubleType(), risk_factors=ArrayType(StringType()),
    **_strings("created_at", "updated_at", "processing_status"),
)
ALERT = _struct(
    **_strings("id", "delivery_id", "home_id", "address", "alert_type", "severity", "message",
               "triggered_at"),
    acknowledged=BooleanType(), related_event_ids=ArrayType(StringType()),
)
DEVICE = _struct(**_strings("device_id", "type", "location", "firmware"))
HOME = _struct(
    **_strings("id", "address", "city", "state", "zip_code", "owner_name"),
    devices=ArrayType(DEVICE), subscription_tier=StringType(), has_garage_camera=BooleanType(),
    has_front_door_camera=BooleanType(), num_garage_doors=IntegerType(), latitude=DoubleType(),
    longitude=DoubleType(),
)
RISK_ASSESSMENT = _struct(
    level=StringType(), score=DoubleType(), factors=ArrayType(StringType()),
    recommendations=ArrayType(StringType()),
)
PROCESSED = StructType(DELIVERY.fields + _struct(
    knowledge_summary=StringType(), risk_assessment=RISK_ASSESSMENT, processed_at=StringType(),
    is_ai_ready=BooleanType(), enrichment_version=StringType(), source_scope=StringType(),
    pii_redacted=BooleanType(), embedding_text=StringType(),
).fields)
AI_READY = StructType(PROCESSED.fields + _struct(
    embedding=ArrayType(FloatType()), embedding_model=StringType(),
    embedding_dimensions=IntegerType(), embedding_generated_at=StringType(),
).fields)
METRICS = _struct(
    total_events_ingested=LongType(), total_deliveries=LongType(), total_alerts=LongType(),
    target_rate=IntegerType(), actual_rate=DoubleType(), start_time=StringType(),
    last_update=StringType(), running=BooleanType(), elapsed_seconds=DoubleType(),
    workers=IntegerType(), batch_size=IntegerType(),
)
MIXED = _struct(**_strings("collection", "key", "value"))

RAW = {"homes": HOME, "events": EVENT, "deliveries": DELIVERY, "alerts": ALERT}
