"""The texts and structs that the enrichment job adds to a delivery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelsight.functions.text import humanize, lookup, risk_level, spaced

# Recommendation per risk factor.
FACTOR_ADVICE = {
    "door_stuck_open": "Dispatch technician to check garage door mechanism",
    "garage_accessible": "Dispatch technician to check garage door mechanism",
    "package_wrong_location": "Notify homeowner of misdelivered package location",
    "not_in_garage": "Notify homeowner of misdelivered package location",
    "package_behind_vehicle": "Send urgent alert to move package before driving",
    "crush_risk": "Send urgent alert to move package before driving",
    "package_theft_risk": "Alert homeowner and review security camera footage",
    "suspicious_activity_after_delivery": "Alert homeowner and review security camera footage",
    "delivery_not_received": "Contact carrier for delivery status update",
    "window_expired": "Contact carrier for delivery status update",
}
NO_ADVICE = "Check your security camera."


def _shown(c: Column) -> Column:
    """A field that is absent still prints, so one gap does not blank the sentence."""
    return F.coalesce(c, F.lit("undefined"))


def event_line(position: Column, event: Column) -> Column:
    return F.concat(
        F.lit("  "), (position + 1).cast("string"), F.lit(". "), _shown(event["summary"]),
        F.lit(" at "), _shown(event["location"]), F.lit(" ("), _shown(event["event_type"]), F.lit(")"),
    )


def knowledge_summary(owner: Column) -> Column:
    """Plain-language story of a delivery; `owner` is the already redacted name."""
    timeline, score, factors = F.col("event_timeline"), F.col("risk_score"), F.col("risk_factors")
    story = F.concat(F.lit("Event sequence: "),
                     F.array_join(F.transform(timeline, lambda e, i: event_line(i, e)), " "))
    listed = spaced(F.array_join(factors, ", ", ""))
    # concat_ws leaves out the parts that do not apply, because they are null
    return F.concat_ws(
        " ",
        F.concat(F.lit("Delivery "), _shown(F.col("id")), F.lit(" for "), owner, F.lit(" at "),
                 _shown(F.col("address")), F.lit(".")),
        F.concat(F.lit("Carrier: "), _shown(F.col("carrier")), F.lit(". Scenario: "),
                 humanize(F.col("scenario_type")), F.lit(".")),
        F.when(F.size(timeline) > 0, story),
        F.concat(F.lit("Final status: "), humanize(F.col("status")), F.lit(".")),
        F.concat(F.lit("Package location: "), spaced(F.col("delivery_location")), F.lit(".")),
        F.when(score > 0, F.format_string("Risk score: %.1f%%.", score * 100)),
        F.when(F.size(factors) > 0, F.concat(F.lit("Risk factors: "), listed, F.lit("."))),
    )


def recommendations(factors: Column) -> Column:
    """Advice per factor in factor order; unknown factors give none, repeats stay."""
    advice = F.filter(F.transform(factors, lambda f: lookup(f, FACTOR_ADVICE)), lambda a: a.isNotNull())
    return F.coalesce(advice, F.array().cast("array<string>"))


def homeowner_recommendations(factors: Column) -> Column:
    """Advice without repeats, first one first; never empty."""
    advice = F.array_distinct(recommendations(factors))
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(NO_ADVICE)))


def risk_assessment(score: Column, factors: Column) -> Column:
    return F.struct(
        risk_level(score).alias("level"),
        score.alias("score"),
        F.coalesce(factors, F.array().cast("array<string>")).alias("factors"),
        recommendations(factors).alias("recommendations"),
    )


def embedding_text(summary: Column, level: Column) -> Column:
    return F.concat(
        F.coalesce(summary, F.lit("")),
        F.lit(" Delivery scenario: "), humanize(F.col("scenario_type")),
        F.lit(". Delivery status: "), humanize(F.col("status")),
        F.lit(". Location: "), _shown(F.col("address")),
        F.lit(". Risk level: "), level, F.lit("."),
    )
