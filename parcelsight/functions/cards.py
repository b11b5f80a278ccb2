"""Sentences and labels shown in the feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelsight.functions.text import HIGH, by_case, lookup, risk_percent, spaced, title_label

# One sentence per scenario for the homeowner feed.
SHORT_STORY = {
    "happy_path":
        "{carrier} package safely delivered inside your garage. "
        "Door confirmed closed and secured — no action needed.",
    "front_door_misdelivery":
        "{carrier} left your package at the front door instead of the garage — "
        "exposed to weather and theft. Retrieve it soon.",
    "package_behind_car":
        "{carrier} placed your package behind your car in the garage — "
        "it could be crushed when you back out. Move it before driving.",
    "door_stuck_open":
        "Garage door stuck open after {carrier} delivery — "
        "package is inside but garage is unsecured. Immediate action required.",
    "no_package_placed":
        "Garage door opened for {carrier} but no package detected inside — "
        "possible missed delivery or wrong drop-off.",
    "delivery_timeout":
        "Expected {carrier} delivery never arrived — "
        "delivery window expired with no carrier activity.",
    "theft_suspicious":
        "Unknown person detected near your {carrier} package at the front door "
        "shortly after delivery. Check your camera immediately.",
}
SHORT_STORY_ELSE = "{carrier} delivery at {location}. Risk: {risk}."

# One longer text per scenario for the comparison view.
LONG_STORY = {
    "happy_path":
        "Your {carrier} package was safely delivered inside your garage. "
        "Analyzed {events} sensor events — door opened, package confirmed, door closed and locked. "
        "No risk factors detected. No action needed.",
    "front_door_misdelivery":
        "{carrier} left your package at the front door instead of the garage. "
        "Analyzed {events} sensor events — camera detected package outside, not in the secure garage zone. "
        "Risk: exposed to weather and theft ({risk}). "
        "Retrieve your package or enable garage-only delivery.",
    "package_behind_car":
        "Your {carrier} package was placed behind your car in the garage — "
        "it could be crushed when you back out. "
        "Analyzed {events} sensor events — camera confirmed package near vehicle. "
        "Move the package before driving ({risk} risk).",
    "door_stuck_open":
        "Your garage door is stuck open after {carrier} delivery. "
        "Package was placed inside, but the door failed to close — "
        "garage is unsecured and exposed to weather and intruders. "
        "Analyzed {events} events over 10+ minutes with no door-close signal. "
        "Immediate action required ({risk} risk).",
    "no_package_placed":
        "Garage door opened for {carrier} but no package was detected inside. "
        "Analyzed {events} sensor events — motion was detected but camera confirmed no package in the "
        "garage zone. Possible missed delivery or wrong drop-off location ({risk} risk).",
    "delivery_timeout":
        "Your expected {carrier} delivery never arrived. "
        "Monitored for the full delivery window with only {events} events — "
        "no carrier activity, no person detected, no package placed. "
        "Contact {carrier} for a status update.",
    "theft_suspicious":
        "An unknown person was detected near your {carrier} package at the front door "
        "minutes after delivery. "
        "Analyzed {events} sensor events — camera flagged a second person after the driver left. "
        "Package may be at risk of theft ({risk} risk). Check your camera immediately.",
}
LONG_STORY_ELSE = "{carrier} delivery analyzed with {events} events. Risk: {risk}."

# Display name per scenario.
SCENARIO_NAMES = {
    "happy_path": "Happy Path",
    "front_door_misdelivery": "Front Door Misdelivery",
    "package_behind_car": "Package Behind Car",
    "door_stuck_open": "Door Stuck Open",
    "no_package_placed": "Missing Package",
    "delivery_timeout": "Delivery Timeout",
    "theft_suspicious": "Suspicious Activity",
}
NO_ACTIVITY = "No recent delivery activity."


def smart_summary() -> Column:
    return by_case(
        F.coalesce(F.col("scenario_type"), F.lit("")), SHORT_STORY, SHORT_STORY_ELSE,
        carrier=F.coalesce(F.col("carrier"), F.lit("Carrier")),
        location=spaced(F.coalesce(F.col("delivery_location"), F.lit(""))),
        risk=risk_percent(F.col("risk_score")),
    )


def scenario_insight(summary: Column | None = None) -> Column:
    """The long text; an existing non-empty knowledge summary wins."""
    text = by_case(
        F.coalesce(F.col("scenario_type"), F.lit("")), LONG_STORY, LONG_STORY_ELSE,
        carrier=F.coalesce(F.col("carrier"), F.lit("Unknown")),
        events=F.coalesce(F.array_size("event_timeline"), F.lit(0)).cast("string"),
        risk=risk_percent(F.col("risk_score")),
    )
    return text if summary is None else F.coalesce(F.nullif(summary, F.lit("")), text)


def scenario_name(scenario: Column) -> Column:
    return F.coalesce(lookup(scenario, SCENARIO_NAMES), title_label(scenario))


def needs_attention(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.0)) >= HIGH


def attention_title(score: Column) -> Column:
    return F.when(needs_attention(score), "Smart Delivery Alert").otherwise("Smart Delivery Update")


def door_status(scenario: Column) -> Column:
    return F.when(scenario == "door_stuck_open", "Stuck Open").otherwise("Closed")


def latest_banner() -> Column:
    return F.concat(
        F.lit("Latest: "), F.coalesce(F.col("carrier"), F.lit("Unknown")), F.lit(" delivery at "),
        F.coalesce(F.col("address"), F.lit("")), F.lit(" — "), smart_summary(),
    )
