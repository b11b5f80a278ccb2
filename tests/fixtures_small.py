"""Constants of the tests, in a module of their own: every folder of tests may have a conftest."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"

TIMELINE = [
    ("evt-1", "delivery_window_start", "garage", "Delivery window opened", "2024-05-01T14:00:00Z"),
    ("evt-2", "person_detected", "driveway", "Person detected at driveway", "2024-05-01T14:40:00Z"),
    ("evt-3", "camera_motion", "front_door", "Motion detected at front_door", "2024-05-01T14:40:30Z"),
    ("evt-4", "package_detected", "front_door", "Package detected at front_door", "2024-05-01T14:40:40Z"),
]
GOLDEN = {
    "id": "del-00042", "home_id": "home-1", "address": "812 Oak Lane, Lisle, IL 60532",
    "owner_name": "Mary Ann Lopez", "status": "completed_risk", "scenario_type": "front_door_misdelivery",
    "carrier": "UPS", "delivery_location": "front_door", "event_ids": [e[0] for e in TIMELINE],
    "event_timeline": TIMELINE, "risk_score": 0.575,
    "risk_factors": ["package_wrong_location", "not_in_garage", "exposure_to_weather"],
    "created_at": "2024-05-01T15:00:00Z", "updated_at": "2024-05-01T15:00:00Z",
    "processing_status": "pending",
}
