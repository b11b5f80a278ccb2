"""Texts worked out by hand, and the edge rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fixtures_small import TIMELINE
from parcelsight.functions import cards, episode, narrative, text
from parcelsight.operators import enrich as en
from parcelsight.operators import feeds, rag

SUMMARY = (
    "Delivery del-00042 for M*** A*** L*** at 812 Oak Lane, Lisle, IL 60532. Carrier: UPS. "
    "Scenario: front door misdelivery. Event sequence:   1. Delivery window opened at garage "
    "(delivery_window_start)   2. Person detected at driveway at driveway (person_detected)   3. Motion "
    "detected at front_door at front_door (camera_motion)   4. Package detected at front_door at "
    "front_door (package_detected) Final status: completed risk. Package location: front door. "
    "Risk score: 57.5%. Risk factors: package wrong location, not in garage, exposure to weather.")
LINES = """  [14:00] Delivery window opened @ garage (delivery_window_start)
  [14:40 +40m] Person detected at driveway @ driveway (person_detected)
  [14:40] Motion detected at front_door @ front_door (camera_motion)
  [14:40] Package detected at front_door @ front_door (package_detected)"""
ADVICE = "Notify homeowner of misdelivered package location"


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_enriched_row(make):
    row = en.enrich(make({})).first()
    assert row["knowledge_summary"] == SUMMARY
    assert row["embedding_text"] == SUMMARY + (
        " Delivery scenario: front door misdelivery. Delivery status: completed risk. "
        "Location: 812 Oak Lane, Lisle, IL 60532. Risk level: high.")
    assert row["owner_name"] == "M*** A*** L***"
    assert row["risk_assessment"].asDict() == {
        "level": "high", "score": 0.575,
        "factors": ["package_wrong_location", "not_in_garage", "exposure_to_weather"],
        "recommendations": [ADVICE, ADVICE]}
    assert (row["processing_status"], row["is_ai_ready"], row["pii_redacted"]) == ("processed", False, True)
    assert len(row["processed_at"]) == 24 and row["processed_at"].endswith("Z")


def test_timeline_lines(make):
    assert value(make({}), rag.format_timeline(F.col("event_timeline"))) == LINES


def test_homeowner_advice_has_no_repeats(make):
    assert value(make({}), narrative.homeowner_recommendations(F.col("risk_factors"))) == [ADVICE]
    assert value(make({"risk_factors": []}), narrative.homeowner_recommendations(F.col("risk_factors"))) == [
        "Check your security camera."]


@pytest.mark.parametrize("name, shown", [
    (None, "R*******"), ("", "R*******"), ("   ", ""), ("mary\tann  lopez ", "M*** A*** L***"), ("Ö x", "Ö*** X***"),
])
def test_redacted_names(make, name, shown):
    assert value(make({"owner_name": name}), text.redact_name(F.col("owner_name"))) == shown


@pytest.mark.parametrize("score, level", [
    (None, "low"), (0.0, "low"), (0.1999, "low"), (0.20, "medium"), (0.45, "high"), (0.75, "critical"), (1.0, "critical"),
])
def test_risk_levels(make, score, level):
    row = en.enrich(make({"risk_score": score})).first()
    assert row["risk_assessment"]["level"] == level
    assert ("Risk score:" in row["knowledge_summary"]) == bool(score)


def test_absent_parts_leave_no_sentence(make):
    row = en.enrich(make({"event_timeline": [], "risk_factors": []})).first()
    assert "Event sequence" not in row["knowledge_summary"]
    assert "Risk factors" not in row["knowledge_summary"]
    row = en.enrich(make({"event_timeline": None, "risk_factors": None, "carrier": None, "status": ""})).first()
    assert "Carrier: undefined." in row["knowledge_summary"]
    assert "Final status: unknown." in row["knowledge_summary"]
    assert row["risk_assessment"]["factors"] == [] and row["risk_assessment"]["recommendations"] == []


def test_only_pending_rows_and_rejects(make):
    rows = make({"id": "a"}, {"id": "b", "processing_status": None}, {"id": "c", "processing_status": "processed"},
                {"id": "d", "delivery_location": None}, {"id": "e", "event_timeline": [TIMELINE[0], None]})
    assert [r["id"] for r in en.enrich(rows).collect()] == ["a"]
    rejected = {r["id"]: r["reject_reason"] for r in en.reject_bad_rows(rows).collect()}
    assert rejected == {"d": "delivery_location is null", "e": "event_timeline has a null entry"}


def test_embedding_text_length_and_flags(make):
    base = en.enrich(make({})).drop("embedding_text")
    rows = base.select("*", F.explode(F.array(F.lit("123456789"), F.lit("1234567890"), F.lit(""))).alias("embedding_text"))
    kept = {r["embedding_text"] for r in en.needs_embedding(rows).collect()}
    assert kept == {"1234567890", ""}          # the empty text falls back to the summary
    done = rows.withColumn("embedding", F.array(F.lit(1.0)))
    assert en.needs_embedding(done).count() == 0
    assert en.needs_embedding(rows.withColumn("is_ai_ready", F.lit(True))).count() == 0
    assert en.needs_embedding(rows.withColumn("is_ai_ready", F.lit(None).cast("boolean"))).count() == 2


def test_enriching_again_drops_the_vector(make):
    had = make({}).withColumns({"embedding": F.array(F.lit(1.0)), "embedding_model": F.lit("m"), "is_ai_ready": F.lit(True)})
    again = en.enrich(had)
    assert "embedding" not in again.columns and again.first()["is_ai_ready"] is False


def test_timeline_is_cut_and_gaps_are_whole_minutes(make):
    at = lambda m, s: f"2024-05-01T10:{m:02d}:{s:02d}Z"
    steps = [(f"e{i}", "door_open", "garage", "s", ts) for i, ts in enumerate(
        [at(0, 0), at(0, 59), at(1, 59), "short", at(5, 0), "2024-05-01Tbad:bad:badZ", at(9, 0), at(8, 0), at(30, 0), at(40, 0)])]
    lines = value(make({"event_timeline": steps}), rag.format_timeline(F.col("event_timeline"))).split("\n")
    assert len(lines) == 8
    assert [line.split("]")[0] for line in lines] == [
        "  [10:00", "  [10:00", "  [10:01 +1m", "  [short", "  [10:05", "  [bad:b", "  [10:09", "  [10:08"]
    assert value(make({"event_timeline": None}), rag.format_timeline(F.col("event_timeline"))) == ""


@pytest.mark.parametrize("score, shown", [(0.125, "12%"), (0.135, "14%"), (0.575, "57%"), (None, "0%"), (1.0, "100%")])
def test_percent_ties_to_even(make, score, shown):
    assert value(make({"risk_score": score}), text.risk_percent(F.col("risk_score"))) == shown


def test_small_labels(make):
    row = make({"scenario_type": "some_new_case", "status": "x"})
    assert value(row, cards.scenario_name(F.col("scenario_type"))) == "Some New Case"
    assert value(row, cards.smart_summary()) == "UPS delivery at front door. Risk: 57%."
    assert value(row, cards.scenario_insight()) == "UPS delivery analyzed with 4 events. Risk: 57%."
    assert value(row, cards.scenario_insight(F.lit("told"))) == "told"
    assert value(row, text.short_time(F.lit("10:00"))) == "10:00"
    assert value(row, text.ellipsize(F.lit("x" * 81), 80)) == "x" * 80 + "..."
    assert value(row, text.ellipsize(F.lit("x" * 80), 80)) == "x" * 80
    assert value(row, episode.alert_severity(F.lit("other"))) == "medium"
    assert value(row, episode.alert_message(F.lit("other"), F.lit("1 Elm"))) == "Alert at 1 Elm: other"
    assert value(row, episode.event_summary(F.lit("other"), F.lit("x"))) == "other"
    assert value(row, episode.actual_delivery_time(F.lit("failed"), F.col("event_timeline"))) is None
    assert value(row, episode.actual_delivery_time(F.lit("completed_risk"), F.col("event_timeline"))) == "2024-05-01T14:40:40Z"


def test_device_fallbacks(spark):
    df = spark.sql("""select array(named_struct('device_id', 'S', 'type', 'garage_door_sensor', 'location', 'garage'),
        named_struct('device_id', 'G', 'type', 'garage_camera', 'location', 'garage')) as d""")
    pick = lambda place, devices=F.col("d"): value(df, episode.pick_device(devices, F.lit(place)))
    assert [pick(p) for p in ("garage", "driveway", "behind_vehicle", "front_door")] == ["S", "G", "G", "S"]
    assert pick("garage", F.filter("d", lambda x: F.lit(False))) == "unknown"


def test_search_filter_off_and_unknown_band(make):
    rows = en.enrich(make({"id": "a"}, {"id": "b", "risk_score": None})).withColumn("is_ai_ready", F.lit(True))
    ids = lambda **f: sorted(r["id"] for r in feeds.search_filter(rows, **f).collect())
    assert ids() == ["a", "b"] and ids(risk_level="odd") == ["a", "b"]
    assert ids(risk_level="low") == [] and ids(risk_level="high") == ["a"]
    assert ids(carrier="' or 1=1 --") == []


def test_door_card_without_deliveries(make):
    row = feeds.door_card(make({}).limit(0)).first()
    assert row.asDict() == {"door": "Closed", "banner": "No recent delivery activity."}


def test_context_without_hits(spark, make):
    hits = en.enrich(make({})).withColumns({"query_id": F.lit(1), "rank": F.lit(1)})
    assert rag.context(hits.limit(0)).count() == 0
    questions = spark.createDataFrame([(1, "why?"), (2, "who?")], "query_id int, question string")
    rows = {r["query_id"]: r["messages"] for r in rag.prompt_rows(rag.context(hits), questions).collect()}
    assert rows[2][1]["content"] == "Context from knowledge base:\n\n\nUser question: who?"
    told = rows[1][1]["content"]
    assert told.startswith("Context from knowledge base:\nFLEET SUMMARY: 1 deliveries retrieved by semantic similarity\n"
                           "Risk distribution: 0 critical, 1 high, 0 medium, 0 low\nCarriers: UPS\n"
                           "Scenarios: front door misdelivery\n"
                           "Common risk factors: package wrong location, not in garage, exposure to weather\n"
                           "\n\n--- Delivery 1: del-00042 ---\n")
    assert f"Event Timeline:\n{LINES}\nIntelligence: {SUMMARY}\nRecommendations: {ADVICE}; {ADVICE}\n" in told
