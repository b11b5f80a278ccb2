"""Counts, distributions and throughput."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelsight.functions.text import risk_level

INDEX_THRESHOLD = 200


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def steady_mean(c: Column) -> Column:
    """Mean summed in decimals: the same whatever the order in which tasks deliver their parts."""
    return F.avg(c.cast("decimal(18,9)")).cast("double")


def collection_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Row count per collection in one job; a collection that cannot be read counts 0."""
    spark = SparkSession.active()
    counts = [
        spark.createDataFrame([(name, 0)], "collection string, row_count bigint") if df is None else
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("collection"), "row_count")
        for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def ai_ready_count(processed: DataFrame) -> DataFrame:
    return processed.agg(F.count_if(F.col("is_ai_ready")).alias("ai_ready"))


def _tagged(**tables: DataFrame) -> DataFrame:
    """One flag frame over several tables, so that their totals need one aggregate and no join."""
    parts = [df.select(F.lit(tag).alias("tag"), flag.alias("flag"))
             for tag, (df, flag) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _count(tag: str) -> Column:
    return F.count_if((F.col("tag") == tag) & F.col("flag"))


def processing_progress(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Deliveries with a status on both sides and their ratio in percent."""
    has_status = F.col("status").isNotNull()
    totals = _tagged(raw=(raw, has_status), processed=(processed, has_status)).agg(
        _count("raw").alias("raw_count"), _count("processed").alias("processed_count"))
    return totals.withColumn("percent", _share(F.col("processed_count"), F.col("raw_count")))


def status_distribution(deliveries: DataFrame) -> DataFrame:
    counts = deliveries.groupBy("status").agg(F.count("*").alias("deliveries"))
    total = F.sum("deliveries").over(W.partitionBy(F.lit(0)))
    return counts.withColumn("percent", _share(F.col("deliveries"), total))


def risk_distribution(deliveries: DataFrame) -> DataFrame:
    level = risk_level(F.col("risk_score"))
    return deliveries.agg(*[
        F.count_if(level == name).alias(name) for name in ("critical", "high", "medium", "low")])


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in order, as rows."""
    return df.where(F.col(column) != "").select(column).distinct().orderBy(column)


def top_risk_factors(hits: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """Most frequent factors; equal counts keep the order of first appearance along `order`."""
    seen = hits.select(*order, F.posexplode("risk_factors").alias("pos", "factor"))
    counts = seen.groupBy("factor").agg(
        F.count("*").alias("occurrences"), F.min(F.struct(*order, "pos")).alias("first_seen"))
    return (counts.orderBy(F.desc("occurrences"), "first_seen").limit(k)
            .select("factor", "occurrences"))


def fleet_overview(homes: DataFrame, deliveries: DataFrame, alerts: DataFrame,
                   processed: DataFrame) -> DataFrame:
    """Headline totals. Processed and AI-ready are both given: a live board shows the former."""
    yes = F.lit(True)
    return _tagged(
        homes=(homes, yes), deliveries=(deliveries, yes), alerts=(alerts, yes),
        processed=(processed, F.col("status").isNotNull()),
        ready=(processed, F.col("is_ai_ready")),
    ).agg(
        _count("homes").alias("homes"), _count("deliveries").alias("deliveries"),
        _count("alerts").alias("alerts"), _count("processed").alias("processed"),
        _count("ready").alias("ai_ready"))


def pattern_groups(deliveries: DataFrame) -> DataFrame:
    """Scenario × carrier with counts, mean risk and the factors its deliveries share.

    Factor lists are reduced to counts per factor first, so no group of deliveries is gathered.
    """
    keys = ["scenario_type", "carrier"]
    groups = deliveries.groupBy(*keys).agg(
        F.count("*").alias("deliveries"), steady_mean(F.col("risk_score")).alias("mean_risk"))
    per_factor = (deliveries.select(*keys, F.explode("risk_factors").alias("factor"))
                  .groupBy(*keys, "factor").agg(F.count("*").alias("n")))
    factors = per_factor.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "factor"))).alias("ranked"))
    listed = factors.select(*keys, F.transform("ranked", lambda f: f["factor"]).alias("shared_factors"))
    return groups.join(listed, keys, "left")


def index_ready(processed: DataFrame, threshold: int = INDEX_THRESHOLD) -> DataFrame:
    return ai_ready_count(processed).withColumn("ready", F.col("ai_ready") >= threshold)


# ---- throughput ---------------------------------------------------------------------------------

def tick_counts(mixed: DataFrame, ts: str = "ingest_ts", tick: str = "1 second") -> DataFrame:
    """Documents per tick and collection. Works on batch frames and on streams with a watermark."""
    kind = F.col("collection")
    return (mixed.groupBy(F.window(ts, tick).alias("w"))
            .agg(F.count_if(kind == "events").alias("events"),
                 F.count_if(kind == "deliveries").alias("deliveries"),
                 F.count_if(kind == "alerts").alias("alerts"))
            .select(F.col("w.start").alias("tick"), "events", "deliveries", "alerts"))


def running_totals(ticks: DataFrame, columns: list[str], order: str = "tick") -> DataFrame:
    """Cumulative sums in two levels: inside each day, plus the total of all days before.

    Days run in parallel; only one row per day meets in the final small window.
    """
    day = F.to_date(order)
    dated = ticks.withColumn("day", day)
    within = W.partitionBy("day").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = dated.groupBy("day").agg(F.min(order).alias("day_start"),
                                    *[F.sum(c).alias(c) for c in columns])
    offsets = days.select(
        "day", F.min("day_start").over(W.partitionBy(F.lit(0))).alias("start"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns])
    summed = dated.select("*", *[F.sum(c).over(within).alias(f"{c}_today") for c in columns])
    return summed.join(offsets, "day").select(
        *ticks.columns, "start",
        *[(F.col(f"{c}_before") + F.col(f"{c}_today")).alias(f"total_{c}") for c in columns])


def throughput(ticks: DataFrame) -> DataFrame:
    """Per tick: rate (events only), running totals, elapsed seconds and mean event rate so far."""
    totals = running_totals(ticks, ["events", "deliveries", "alerts"])
    elapsed = (F.unix_timestamp("tick") - F.unix_timestamp("start") + 1).cast("double")
    return totals.select(
        "tick", F.col("events").cast("double").alias("actual_rate"),
        F.col("total_events").alias("total_events_ingested"), "total_deliveries", "total_alerts",
        elapsed.alias("elapsed_seconds"), (F.col("total_events") / elapsed).alias("mean_rate"))
