"""Texts and lookups used while deliveries and alerts are assembled from events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelsight.functions.text import by_case, lookup

# Text per event type.
EVENT_TEXT = {
    "delivery_window_start": "Delivery window opened",
    "delivery_window_end": "Delivery window expired",
    "person_detected": "Person detected at {location}",
    "door_open": "Garage door opened",
    "door_close": "Garage door closed",
    "door_stuck": "Garage door stuck open - alert triggered",
    "camera_motion": "Motion detected at {location}",
    "package_detected": "Package detected at {location}",
    "package_not_detected": "No package detected after door opened",
    "delivery_confirmed": "Delivery confirmed successfully",
    "delivery_timeout": "Delivery timed out - no activity detected",
    "unknown_person": "Unknown person detected near package",
}

# Severity and message per alert type, alert type per scenario.
ALERT_SEVERITY = {
    "theft_risk": "critical",
    "door_stuck": "high",
    "package_at_risk": "high",
    "misdelivery": "medium",
    "no_package": "medium",
    "delivery_timeout": "low",
}
ALERT_TEXT = {
    "misdelivery": "Package delivered to front door instead of garage at {street}",
    "package_at_risk": "Package placed behind vehicle in garage at {street} - crush risk",
    "door_stuck": "Garage door stuck open at {street} - security risk",
    "no_package": "Garage door opened but no package detected at {street}",
    "delivery_timeout": "Expected delivery not received at {street} - window expired",
    "theft_risk": "Suspicious activity detected near package at {street} - possible theft",
}
ALERT_OF_SCENARIO = {
    "front_door_misdelivery": "misdelivery",
    "package_behind_car": "package_at_risk",
    "door_stuck_open": "door_stuck",
    "no_package_placed": "no_package",
    "delivery_timeout": "delivery_timeout",
    "theft_suspicious": "theft_risk",
}
# Severities from worst to mildest.
SEVERITIES = ("critical", "high", "medium", "low")


def event_summary(event_type: Column, location: Column) -> Column:
    return by_case(event_type, EVENT_TEXT, "{type}", type=event_type, location=location)


def alert_severity(alert_type: Column) -> Column:
    return F.coalesce(lookup(alert_type, ALERT_SEVERITY), F.lit("medium"))


def alert_message(alert_type: Column, street: Column) -> Column:
    return by_case(alert_type, ALERT_TEXT, "Alert at {street}: {type}", street=street, type=alert_type)


def full_address(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    return F.format_string("%s, %s, %s %s", street, city, state, zip_code)


def actual_delivery_time(status: Column, timeline: Column) -> Column:
    done = status.isin("completed_success", "completed_risk")
    return F.when(done & (F.size(timeline) > 0), F.try_element_at(timeline, F.lit(-1))["timestamp"])


def pick_device(devices: Column, location: Column) -> Column:
    """First device at the place; driveway and behind_vehicle borrow the garage camera."""
    here = F.filter(devices, lambda d: d["location"] == location)
    garage_camera = F.filter(
        devices, lambda d: (d["location"] == "garage") & (d["type"] == "garage_camera"))
    first = F.lit(1)
    return F.coalesce(
        F.try_element_at(here, first)["device_id"],
        F.when(location.isin("driveway", "behind_vehicle"),
               F.try_element_at(garage_camera, first)["device_id"]),
        F.try_element_at(devices, first)["device_id"],
        F.lit("unknown"),
    )
