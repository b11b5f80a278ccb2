"""Hot keys give the plain result, and plans keep the shape they need on large data."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtures_small import SMALL
from parcelsight.functions.text import iso_time
from parcelsight.operators import enrich as en
from parcelsight.operators import episodes, feeds, joins, metrics, sensors
from parcelsight.operators.skew import balanced_join, heavy_keys
from parcelsight.plans import fixtures as fx
from parcelsight.sources import readers, tables


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def skewed(spark):
    """Events of which a third belong to one home and one delivery, and some to none."""
    n = F.col("id")
    hot = n % 3 == 0
    return spark.range(6000).select(
        F.concat(F.lit("e"), F.lpad(n.cast("string"), 5, "0")).alias("id"),
        F.element_at(F.array(*[F.lit(t) for t in ("door_open", "door_close", "door_stuck", "camera_motion")]),
                     (n % 7 % 4 + 1).cast("int")).alias("type"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("h"), (n % 50).cast("string"))).alias("home_id"),
        F.when(n % 100 == 1, None).when(hot, "d-hot").otherwise(F.concat(F.lit("d"), (n % 400).cast("string"))).alias("delivery_id"),
        F.lit("garage").alias("location"),
        F.timestamp_seconds(F.lit(1_700_000_000) + n * 997 % 500_000).alias("event_ts"),
    ).withColumn("timestamp", iso_time(F.col("event_ts"))).cache()


def test_balanced_join_equals_plain_join(spark, skewed):
    homes = skewed.select("home_id").distinct().where("home_id <> 'h7'").withColumn("tag", F.upper("home_id"))
    assert [r["home_id"] for r in heavy_keys(skewed, "home_id", 500).collect()] == ["hot"]
    cut = balanced_join(skewed, homes, "home_id", "id", rows_per_part=100)
    cols = skewed.columns + ["tag"]
    assert same(cut.select(cols), skewed.join(homes, "home_id").select(cols))
    left = balanced_join(skewed, homes, "home_id", "id", "left", rows_per_part=100)
    assert same(left.select(cols), skewed.join(homes, "home_id", "left").select(cols))


def test_parts_hold_all_events(skewed):
    built = episodes.assemble_deliveries(skewed, part_events=200).collect()
    assert sorted(i for r in built for i in r["event_ids"]) == sorted(r["id"] for r in skewed.select("id").collect())
    whole = {}
    for r in sorted(built, key=lambda r: r["part"]):
        whole.setdefault((r["delivery_id"], r["home_id"]), []).append(r)
    assert len(whole["d-hot", "hot"]) > 5 and (None, "hot") in whole
    for parts in whole.values():
        assert [r["part"] for r in parts] == list(range(len(parts)))
        assert all(r["n_events"] == 200 for r in parts[:-1]) and 0 < parts[-1]["n_events"] <= 200
        entries = [(e["timestamp"], e["event_id"]) for r in parts for e in r["event_timeline"]]
        assert entries == sorted(entries) and [i for r in parts for i in r["event_ids"]] == [e[1] for e in entries]


def test_sliced_next_equals_one_window(skewed):
    sliced = sensors.with_next(skewed, "home_id", "event_ts", "id", "type", unit="hour")
    plain = skewed.withColumn("next", F.lead(F.struct("event_ts", "id", "type")).over(
        W.partitionBy("home_id").orderBy("event_ts", "id")))
    assert same(sliced.select(plain.columns), plain)


def test_sliced_totals_equal_one_window(skewed):
    ticks = metrics.tick_counts(skewed.select(F.col("event_ts").alias("ingest_ts"), F.lit("events").alias("collection")))
    got = metrics.running_totals(ticks, ["events"]).select("tick", "total_events")
    plain = ticks.select("tick", F.sum("events").over(W.partitionBy(F.lit(0)).orderBy("tick")
                                                      .rowsBetween(W.unboundedPreceding, 0)).alias("total_events"))
    assert same(got, plain) and ticks.select(F.to_date("tick")).distinct().count() > 3


def test_sessions_at_exact_gap(spark):
    base = [(0, "a"), (100, "a"), (201, "a"), (0, "b")]
    df = spark.createDataFrame(base, "s int, home_id string").select(
        "home_id", F.timestamp_seconds("s").alias("event_ts"), F.lit("door_open").alias("type"), F.lit("x").alias("location"))
    assert same(episodes.session_episodes(df, 100), episodes.live_sessions(df, "100 seconds"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    fx.deliveries(spark, SMALL).write.parquet(f"{root}/raw")
    raw = spark.read.parquet(f"{root}/raw")
    en.enrich(raw).write.parquet(f"{root}/processed")
    episodes.derive_alerts(raw).write.parquet(f"{root}/alerts")
    return raw, spark.read.parquet(f"{root}/processed"), spark.read.parquet(f"{root}/alerts")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_first_keeps_n_rows_per_task(stored):
    raw, processed, alerts = stored
    for df in (feeds.recent_raw(raw), feeds.recent_processed(processed), feeds.recent_alerts(alerts, "high")):
        rows, _, bound = plan(df).partition("Subquery")
        assert "TakeOrderedAndProject" in rows and "Exchange" not in rows
        assert "TakeOrderedAndProject" in bound and "Exchange" not in bound
    assert "EqualTo(severity,high)" in plan(feeds.recent_alerts(alerts, "high"))
    assert "ReadSchema: struct<created_at:string>" in plan(feeds.recent_raw(raw))


def test_newest_equals_one_sort(spark, stored):
    raw, processed, _ = stored
    for n in (1, 20, 5000):
        plain = raw.where("created_at is not null").orderBy(F.desc("created_at"), "id").limit(n)
        assert same(feeds.recent_raw(raw, n).select("id"), plain.select("id"))
    assert feeds.recent_raw(raw.limit(0)).count() == 0
    undated = processed.limit(5).withColumn("created_at", F.lit(None).cast("string"))
    few = processed.limit(30).unionByName(undated)
    got = feeds.recent_processed(few, 33).collect()
    assert len(got) == 33 and [r["created_at"] is None for r in got] == [False] * 30 + [True] * 3


def test_day_layout_prunes(spark, stored, tmp_path):
    raw = stored[0].where("created_at like '1998-10%'")
    tables.write_by_day(raw, "deliveries", str(tmp_path / "raw"))
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert same(back.drop("day").select(raw.columns), raw)
    assert "PartitionFilters: [isnotnull(day" in plan(back.where("day = '1998-10-03'"))


def test_ranking_is_cut_before_the_shuffle(stored):
    raw, _, alerts = stored
    for df in (feeds.balanced_alerts(alerts, 10), feeds.recent_per_group(raw, "home_id")):
        text = plan(df)
        exchange = text.index("Exchange hashpartitioning")
        assert "WindowGroupLimit" in text[exchange:] and "Partial" in text[exchange:]
    picked = plan(feeds.diverse_pick(feeds.recent_per_group(raw, "home_id"), 6, "home_id"))
    assert picked.count("Exchange") == 1


def test_counts_read_only_their_columns(stored):
    raw, processed, _ = stored
    text = plan(metrics.processing_progress(raw, processed))
    assert text.count("ReadSchema: struct<status:string>") == 2 and "Join" not in text
    assert "ReadSchema: struct<risk_score:double>" in plan(metrics.risk_distribution(raw))


def test_enrichment_needs_no_shuffle(stored):
    text = plan(en.enrich(stored[0]))
    assert "Exchange" not in text and "EqualTo(processing_status,pending)" in text and "Python" not in text


def test_time_bound_skips_files(spark, stored, tmp_path):
    """The n-th newest time reaches the scan of the second step as a pushed filter."""
    path = str(tmp_path / "sorted")
    stored[0].repartitionByRange(8, "created_at").sortWithinPartitions("created_at").write.parquet(path)
    df = feeds.recent_raw(spark.read.parquet(path), 20)
    executed = df._jdf.queryExecution().executedPlan()
    assert executed.executeCollect() is not None
    leaves = executed.executedPlan().plan().collectLeaves()      # adaptive plan, result stage
    read = [leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())]
    assert sum(read) < 1500 / 2, read


def test_no_owner_name_in_processed_texts(stored):
    raw, processed, _ = stored
    audit = joins.redaction_audit(raw, processed)
    assert audit.count() == raw.count() and audit.where("name_leaked").isEmpty()
    leaky = processed.withColumn("knowledge_summary", F.concat("knowledge_summary", F.lit(" Customer 000000007")))
    assert not joins.redaction_audit(raw, leaky).where("name_leaked").isEmpty()


def test_json_lines_are_compressed_in_bounded_files(spark, stored, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "JSON_ROWS", 100)
    path = str(tmp_path / "lines")
    raw = stored[0].drop("vec_id", "street").coalesce(1)
    tables.write_json(raw, path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == -(-raw.count() // 100) and all(f.endswith(".json.gz") for f in files)
    back = readers.read_raw(spark, "deliveries", path)
    assert same(back.drop(readers.CORRUPT).select(raw.columns), raw)


def test_texts_to_embed_are_made_once(spark):
    """The filter on the length of a text reads the text that was made; it does not make it again."""
    n = F.col("id")
    rows = spark.range(20).select(
        n.cast("string").alias("id"), F.lit("processed").alias("processing_status"), (n % 5 == 0).alias("is_ai_ready"),
        F.concat_ws(" ", F.lit("made text"), F.when(n % 3 > 0, n)).alias("knowledge_summary"),
        F.when(n % 2 == 0, F.concat_ws(" ", F.lit("made"), n)).alias("embedding_text"))
    found = en.needs_embedding(rows)
    assert found.columns == rows.columns
    # "made" with a number is too short, and so is "made text" alone
    assert sorted(int(r["id"]) for r in found.collect()) == [n for n in range(20) if n % 2 and n % 3 and n % 5]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("concat_ws" in line for line in plan.splitlines() if "Filter" in line)
