"""Feeds: filters, projections, newest-first lists, balanced and diverse picks, card tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelsight.functions import cards
from parcelsight.functions.episode import SEVERITIES
from parcelsight.functions.narrative import homeowner_recommendations
from parcelsight.functions.text import (
    HIGH, ellipsize, in_risk_band, risk_percent, risk_tier, short_time, spaced, title_label,
)

PROCESSED_FEED = (
    "id", "owner_name", "address", "status", "scenario_type", "carrier", "risk_score",
    "knowledge_summary", "risk_assessment", "delivery_location", "is_ai_ready", "created_at",
    "processing_status",
)
SEARCH_RESULT = (
    "id", "owner_name", "address", "status", "scenario_type", "knowledge_summary",
    "risk_assessment", "carrier", "risk_score", "delivery_location", "event_timeline",
    "risk_factors",
)
ALERT_PREVIEW, RESULT_PREVIEW = 80, 250


# ---- predicates ---------------------------------------------------------------------------------

def ai_ready(processed: DataFrame) -> DataFrame:
    return processed.where(F.col("is_ai_ready"))


def search_predicate(carrier: str = "", scenario: str = "", status: str = "",
                     risk_level: str = "") -> Column:
    """AI-ready and every filter that is set. Values become literals, never query text."""
    terms = [F.col("is_ai_ready")]
    for name, value in (("carrier", carrier), ("scenario_type", scenario), ("status", status)):
        if value:
            terms.append(F.col(name) == value)
    band = in_risk_band(F.col("risk_score"), risk_level)
    if band is not None:
        terms.append(band)
    return reduce(lambda a, b: a & b, terms)


def search_filter(processed: DataFrame, **filters: str) -> DataFrame:
    return processed.where(search_predicate(**filters))


def homeowner_alert_pool(deliveries: DataFrame) -> DataFrame:
    return deliveries.where(F.coalesce(F.col("risk_score"), F.lit(0.0)) >= HIGH)


def by_scenario(deliveries: DataFrame, scenario: str) -> DataFrame:
    """Any one delivery of the scenario; the lowest id, so that it is the same one each time."""
    return deliveries.where(F.col("scenario_type") == scenario).orderBy("id").limit(1)


def by_severity(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.where(F.col("severity") == severity)


# ---- projections --------------------------------------------------------------------------------

def processed_feed_projection(processed: DataFrame) -> DataFrame:
    return processed.select(F.col("id").alias("doc_id"), *PROCESSED_FEED)


def search_projection(hits: DataFrame) -> DataFrame:
    extra = [c for c in ("query_id", "rank", "distance", "score") if c in hits.columns]
    return hits.select(F.col("id").alias("doc_id"), *SEARCH_RESULT, *extra)


# ---- newest first -------------------------------------------------------------------------------

def newest(df: DataFrame, ts: str, n: int) -> DataFrame:
    """The n newest rows, read in two steps.

    The first step reads the time column alone and gives the n-th newest time. The second reads whole
    rows, but only where a file's time range reaches that far (the bound is pushed to the scan); each
    task keeps n of them (TakeOrderedAndProject). Ties at the bound all take part.
    """
    bound = df.select(ts).orderBy(F.desc(ts)).limit(n).agg(F.min(ts)).scalar()
    reach = df.where((F.col(ts) >= bound) | F.col(ts).isNull())
    return reach.orderBy(F.desc(ts), "id").limit(n)


def recent_raw(deliveries: DataFrame, n: int = 20) -> DataFrame:
    return newest(deliveries.where(F.col("created_at").isNotNull()), "created_at", n)


def recent_processed(processed: DataFrame, n: int = 20) -> DataFrame:
    rows = processed_feed_projection(processed.where(F.col("status").isNotNull()))
    return newest(rows, "created_at", n)


def recent_alerts(alerts: DataFrame, severity: str, n: int = 20) -> DataFrame:
    return newest(by_severity(alerts, severity), "triggered_at", n)


def balanced_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    """The newest few of each severity, newest first, cut to n.

    Ranking is limited to the first rows per severity before the shuffle (WindowGroupLimit), so a
    severity that holds most alerts sends only a handful of rows per task.
    """
    per_severity = max(n // 4, 3)
    worst_first = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    newest_first = W.partitionBy("severity").orderBy(F.desc("triggered_at"), "id")
    return (alerts.where(F.col("severity").isin(*SEVERITIES))
            .withColumn("severity_row", F.row_number().over(newest_first))
            .where(F.col("severity_row") <= per_severity)
            .orderBy(F.desc("triggered_at"), worst_first, "id").limit(n)
            .drop("severity_row"))


# ---- diverse pick -------------------------------------------------------------------------------

def recent_per_group(deliveries: DataFrame, group: str, n: int = 20) -> DataFrame:
    """Newest n rows per group with their position `pos`; cut to n per task before the shuffle."""
    order = W.partitionBy(group).orderBy(F.desc("created_at"), "id")
    return (deliveries.where(F.col("created_at").isNotNull())
            .withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n))


def diverse_pick(items: DataFrame, total: int, group: str | None = None, pos: str = "pos") -> DataFrame:
    """First row per scenario, then first row per address not yet shown, then the rest.

    `items` must already be cut to a short list (per group when `group` is given) and carry its
    position; every window below then works on lists of that length. Adds `pick` and `pick_pass`.
    """
    keys = [group] if group else []
    first_of = lambda c: F.row_number().over(W.partitionBy(*keys, c).orderBy(pos)) == 1
    marked = (items.withColumn("first_scenario", first_of("scenario_type"))
              .withColumn("first_address", first_of("address"))
              .withColumn("address_shown", F.max("first_scenario").over(W.partitionBy(*keys, "address"))))
    ordered = marked.withColumn(
        "pick_pass",
        F.when(F.col("first_scenario"), 1)
         .when(F.col("first_address") & ~F.col("address_shown"), 2).otherwise(3),
    ).drop("first_scenario", "first_address", "address_shown")
    if group is None:
        # a short list: the whole pick is one small sort
        rank = W.partitionBy(F.lit(0)).orderBy("pick_pass", pos)
    else:
        rank = W.partitionBy(group).orderBy("pick_pass", pos)
    return ordered.withColumn("pick", F.row_number().over(rank)).where(F.col("pick") <= total)


def with_position(short_list: DataFrame) -> DataFrame:
    """Position in a list already cut by `newest`."""
    return short_list.withColumn(
        "pos", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), "id")))


def comparison_row(deliveries: DataFrame, scenario: str = "package_behind_car") -> DataFrame:
    """One delivery of the scenario, else the newest delivery."""
    wanted = by_scenario(deliveries, scenario).withColumn("choice", F.lit(0))
    latest = recent_raw(deliveries, 1).withColumn("choice", F.lit(1))
    return wanted.unionByName(latest).orderBy("choice").limit(1).drop("choice")


# ---- card tables --------------------------------------------------------------------------------

def _label(c: Column) -> Column:
    return title_label(F.coalesce(c, F.lit("")))


def delivery_cards(deliveries: DataFrame, *keep: str) -> DataFrame:
    score = F.coalesce(F.col("risk_score"), F.lit(0.0))
    tier = risk_tier(score)
    tag = F.when(tier == "critical", "CRITICAL").when(tier == "risk", "RISK").otherwise("Safe")
    return deliveries.select(
        *keep, "id",
        _label(F.col("status")).alias("status_label"),
        tier.alias("tier"),
        F.concat_ws(" ", risk_percent(score), tag).alias("risk_label"),
        short_time(F.coalesce(F.col("created_at"), F.lit(""))).alias("time"),
        cards.smart_summary().alias("summary"),
        cards.scenario_name(F.coalesce(F.col("scenario_type"), F.lit(""))).alias("scenario"),
        _label(F.col("delivery_location")).alias("location"),
        F.coalesce(F.col("carrier"), F.lit("")).alias("carrier"),
    )


def homeowner_alert_cards(deliveries: DataFrame, *keep: str) -> DataFrame:
    return deliveries.select(
        *keep, "id",
        F.concat(cards.scenario_name(F.coalesce(F.col("scenario_type"), F.lit(""))), F.lit(" — "),
                 F.coalesce(F.col("address"), F.lit(""))).alias("title"),
        homeowner_recommendations(F.col("risk_factors"))[0].alias("advice"),
        F.when(F.col("status") == "suspicious", "critical").otherwise("warning").alias("banner"),
        F.concat(risk_percent(F.col("risk_score")), F.lit(" RISK")).alias("risk_label"),
        F.coalesce(F.col("carrier"), F.lit("")).alias("carrier"),
    )


def comparison_cards(deliveries: DataFrame) -> DataFrame:
    """The long text beside the short facts, for the before/after view."""
    summary = F.col("knowledge_summary") if "knowledge_summary" in deliveries.columns else None
    score = F.coalesce(F.col("risk_score"), F.lit(0.0))
    tier = risk_tier(score)
    return deliveries.select(
        "id",
        cards.attention_title(score).alias("title"),
        cards.scenario_insight(summary).alias("insight"),
        F.when(tier == "critical", "Critical").when(tier == "risk", "At Risk").otherwise("Safe")
         .alias("safety"),
        title_label(F.coalesce(F.col("delivery_location"), F.lit("garage"))).alias("location"),
        F.coalesce(F.col("carrier"), F.lit("Unknown")).alias("carrier"),
        F.concat(F.lit("Risk: "), risk_percent(score)).alias("risk_label"),
    )


def door_card(deliveries: DataFrame) -> DataFrame:
    """Door state and banner of the newest delivery; one row even when there is none."""
    latest = recent_raw(deliveries, 1).select(
        cards.door_status(F.col("scenario_type")).alias("door"), cards.latest_banner().alias("banner"))
    return latest.agg(
        F.coalesce(F.max("door"), F.lit("Closed")).alias("door"),
        F.coalesce(F.max("banner"), F.lit(cards.NO_ACTIVITY)).alias("banner"))


def alert_cards(alerts: DataFrame) -> DataFrame:
    message = F.coalesce(F.col("message"), F.lit(""))
    return alerts.select(
        "id", F.coalesce(F.col("severity"), F.lit("medium")).alias("severity"),
        _label(F.col("alert_type")).alias("alert_label"),
        short_time(F.coalesce(F.col("triggered_at"), F.lit(""))).alias("time"),
        F.concat(F.coalesce(F.col("address"), F.lit("")), F.lit(" — "),
                 ellipsize(message, ALERT_PREVIEW)).alias("text"),
    )


def search_cards(hits: DataFrame) -> DataFrame:
    """Ranked result table; expects the `rank` and `score` columns of a search."""
    risk = F.coalesce(F.col("risk_score"), F.lit(0.0))
    keys = [c for c in ("query_id",) if c in hits.columns]
    return hits.select(
        *keys, "rank", "id",
        cards.scenario_name(F.coalesce(F.col("scenario_type"), F.lit(""))).alias("scenario"),
        F.format_string("%.4f", F.col("score")).alias("score_label"),
        ellipsize(F.coalesce(F.col("knowledge_summary"), F.lit("No summary available")),
                  RESULT_PREVIEW).alias("summary"),
        F.coalesce(F.col("carrier"), F.lit("N/A")).alias("carrier"),
        F.coalesce(F.col("address"), F.lit("N/A")).alias("address"),
        risk_percent(risk).alias("risk_label"),
        F.when(risk < 0.2, "success").when(risk < 0.75, "risk").otherwise("failed").alias("badge"),
        F.coalesce(F.col("owner_name"), F.lit("N/A")).alias("owner_name"),
        spaced(F.coalesce(F.col("status"), F.lit(""))).alias("status_label"),
    )
