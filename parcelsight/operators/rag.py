"""Context text for a question: fleet header, delivery blocks, message rows, sources.

Every function takes hits: the search columns plus query_id and rank, k rows per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.cards import scenario_name
from parcelsight.functions.text import risk_level, risk_percent, short_time, spaced

TOP_FACTORS = 5
TIMELINE_EVENTS = 8

SYSTEM_TEXT = (
    "You are an operations analyst for package deliveries. Group the deliveries below by scenario, "
    "shared risk factors and carrier, explain each group from its event timeline, point out telling "
    "gaps between events, and close with recommended actions ranked by severity. "
    "Refer to delivery ids, addresses and risk factors from the context only."
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def format_timeline(timeline: Column, max_events: int = TIMELINE_EVENTS) -> Column:
    """One line per event with clock time and the whole minutes since the event before."""
    shown = F.slice(timeline, 1, max_events)

    def moment(ts: Column) -> Column:
        return F.when(F.length(ts) >= 19, F.left(ts, F.lit(19)).try_cast("timestamp_ntz"))

    def line(event: Column, i: Column) -> Column:
        ts = _text(event["timestamp"])
        before = _text(F.get(timeline, i - 1)["timestamp"])
        minutes = F.floor(F.timestamp_diff("SECOND", moment(before), moment(ts)) / 60)
        delta = F.when(minutes > 0, F.concat(F.lit(" +"), minutes.cast("string"), F.lit("m"))).otherwise("")
        return F.concat(F.lit("  ["), short_time(ts), delta, F.lit("] "), _text(event["summary"]),
                        F.lit(" @ "), _text(event["location"]), F.lit(" ("), _text(event["event_type"]),
                        F.lit(")"))

    return F.coalesce(F.array_join(F.transform(shown, line), "\n"), F.lit(""))


def delivery_block() -> Column:
    """Fixed lines per hit; timeline and recommendations appear only when there are any."""
    factors, advice = F.col("risk_factors"), F.col("risk_assessment.recommendations")
    timeline = format_timeline(F.col("event_timeline"))
    listed = F.when(F.size(factors) > 0, spaced(F.array_join(factors, ", "))).otherwise("none")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("--- Delivery "), F.col("rank").cast("string"), F.lit(": "), _text(F.col("id")), F.lit(" ---")),
        F.concat(F.lit("Scenario: "), spaced(_text(F.col("scenario_type"))), F.lit(" | Status: "),
                 spaced(_text(F.col("status"))), F.lit(" | Carrier: "), _text(F.col("carrier"))),
        F.concat(F.lit("Address: "), _text(F.col("address")), F.lit(" | Location: "),
                 spaced(_text(F.col("delivery_location")))),
        F.concat(F.lit("Owner: "), _text(F.col("owner_name")), F.lit(" (redacted)")),
        F.concat(F.lit("Risk: "), risk_percent(F.col("risk_score")), F.lit(" ["),
                 _text(F.col("risk_assessment.level")), F.lit("]")),
        F.concat(F.lit("Risk Factors: "), listed),
        F.when(timeline != "", F.concat(F.lit("Event Timeline:\n"), timeline)),
        F.concat(F.lit("Intelligence: "),
                 F.coalesce(F.col("knowledge_summary"), F.lit("No summary available"))),
        F.when(F.size(advice) > 0, F.concat(F.lit("Recommendations: "), F.array_join(advice, "; "))),
    )
    return F.concat(F.lit("\n"), lines, F.lit("\n"))


def delivery_blocks(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "id", delivery_block().alias("block"))


def _lists(hits: DataFrame, *more: Column) -> DataFrame:
    """Hits of each query as one array in rank order: k entries, because a search returned them."""
    entry = F.struct("rank", risk_level(F.col("risk_score")).alias("level"), "carrier",
                     "scenario_type", F.coalesce("risk_factors", F.array()).alias("factors"), *more)
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("hits"))


def _header() -> Column:
    hits = F.col("hits")
    in_band = lambda name: F.size(F.filter(hits, lambda h: h["level"] == name)).cast("string")
    names = lambda field: F.array_sort(F.array_distinct(F.filter(
        F.transform(hits, lambda h: h[field]), lambda v: v != "")))
    # labels are ordered after underscores became blanks
    scenarios = F.array_sort(F.transform(names("scenario_type"), spaced))
    every = F.flatten(F.transform(hits, lambda h: h["factors"]))
    counted = F.transform(F.array_distinct(every), lambda f, i: F.struct(
        (-F.size(F.filter(every, lambda g: g == f))).alias("n"), i.alias("first"), f.alias("factor")))
    top = F.transform(F.slice(F.array_sort(counted), 1, TOP_FACTORS), lambda c: spaced(c["factor"]))
    factors = F.when(F.size(top) > 0, F.array_join(top, ", ")).otherwise("none")
    return F.concat(
        F.lit("FLEET SUMMARY: "), F.size(hits).cast("string"),
        F.lit(" deliveries retrieved by semantic similarity\nRisk distribution: "),
        in_band("critical"), F.lit(" critical, "), in_band("high"), F.lit(" high, "),
        in_band("medium"), F.lit(" medium, "), in_band("low"), F.lit(" low\nCarriers: "),
        F.array_join(names("carrier"), ", "), F.lit("\nScenarios: "), F.array_join(scenarios, ", "),
        F.lit("\nCommon risk factors: "), factors, F.lit("\n"))


def fleet_summary(hits: DataFrame) -> DataFrame:
    return _lists(hits).select("query_id", _header().alias("summary"))


def context(hits: DataFrame) -> DataFrame:
    """Header and blocks in rank order; one shuffle by query builds all of it."""
    blocks = F.transform("hits", lambda h: h["block"])
    return _lists(hits, delivery_block().alias("block")).select(
        "query_id", F.array_join(F.concat(F.array(_header()), blocks), "\n").alias("context"))


def prompt_rows(contexts: DataFrame, questions: DataFrame, system: str = SYSTEM_TEXT) -> DataFrame:
    """Message rows per question; a question without hits gets an empty context."""
    text = F.concat(F.lit("Context from knowledge base:\n"), _text(F.col("context")),
                    F.lit("\n\nUser question: "), F.col("question"))
    return questions.join(contexts, "query_id", "left").select(
        "query_id",
        F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"))


def source_lines(hits: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("Delivery "), F.col("rank").cast("string"), F.lit(": "),
        scenario_name(_text(F.col("scenario_type"))), F.lit(" | "),
        F.coalesce(F.col("carrier"), F.lit("N/A")), F.lit(" | Risk: "), risk_percent(F.col("risk_score")),
        F.lit(" | "), F.coalesce(F.col("owner_name"), F.lit("N/A")), F.lit(" at "),
        F.coalesce(F.col("address"), F.lit("N/A")))
    return hits.select("query_id", "rank", line.alias("source"))
