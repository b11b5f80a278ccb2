"""The registered queries. Each runs over whole tables; its oracle recomputes it in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelsight import schemas
from parcelsight.functions.text import iso_time, redact_name, risk_level
from parcelsight.functions.vector_math import cosine_distance
from parcelsight.operators import (
    enrich as en, episodes, feeds, joins, metrics, privacy, rag, sensors, vectors,
)
from parcelsight.plans import fixtures as fx
from parcelsight.plans.catalog import query
from parcelsight.plans.oracle_base import (
    BASE, ISO, NAME_SQL, SHORT_SQL, VECTORS, level_sql, percent_sql, spaced_sql, title_sql,
)
from parcelsight.session import scratch_dir
from parcelsight.sources import changes, readers, tables
from parcelsight.streaming import jobs

STAMP = "2024-01-01T00:00:00.000Z"
EVENTS_PER_FILE = 100_000


def _joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def _timeline_text() -> Column:
    return F.array_join(F.transform("event_timeline", lambda e: F.concat_ws(
        "|", e["event_id"], e["event_type"], e["location"], e["summary"], e["timestamp"])), ";")


def _alerts(spark, sf) -> DataFrame:
    return episodes.derive_alerts(fx.deliveries(spark, sf))


# ---- sources and sinks --------------------------------------------------------------------------

@query("typed_json_read", BASE + """
select id, home_id, carrier, risk_score, n_events, event_ids, created_at from dl""")
def typed_json_read(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "raw-json")
    docs = fx.deliveries(spark, sf).drop("vec_id", "street")
    tables.write_json(docs, path)
    rows = readers.read_raw(spark, "deliveries", path)
    return rows.where(F.col(readers.CORRUPT).isNull()).select(
        "id", "home_id", "carrier", "risk_score",
        F.size("event_timeline").cast("bigint").alias("n_events"), _joined("event_ids"), "created_at")


def _orders_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = fx.table(spark, sf, "orders").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)


@query("streamed_enrichment", BASE + f"""
select id, owner_name, knowledge_summary, embedding_text, '{STAMP}' as processed_at from px""")
def streamed_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "enrichment")
    raw = fx.deliveries(spark, sf, _orders_stream(spark, sf))
    jobs.start_enrichment(raw, f"{root}/processed", f"{root}/state", processed_at=F.lit(STAMP)).awaitTermination()
    return spark.read.parquet(f"{root}/processed").select(
        "id", "owner_name", "knowledge_summary", "embedding_text", "processed_at")


@query("streamed_two_stage", BASE + """
select id, 'processed' as processing_status, true as is_ai_ready, cast(256 as bigint) as embedding_dimensions
from px""")
def streamed_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "two-stage")
    raw = fx.deliveries(spark, sf, _orders_stream(spark, sf))
    jobs.start_enrichment(raw, f"{root}/processed", f"{root}/state1").awaitTermination()
    log = spark.read.parquet(f"{root}/processed")
    stage2 = spark.readStream.schema(log.schema).parquet(f"{root}/processed")
    jobs.start_embedding(stage2, f"{root}/ready", f"{root}/state2").awaitTermination()
    # only what is shown takes part: texts and vectors stay out of the shuffle
    ready = spark.read.parquet(f"{root}/ready").select(
        "id", "processing_status", "is_ai_ready",
        F.col("embedding_dimensions").cast("bigint").alias("embedding_dimensions"), "processed_at")
    return changes.upsert_latest(ready, "id", ["processed_at"]).drop("processed_at")


def _status_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivery as created, and again one hour later as completed where its order is final."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    first = fx.delivery_rows(spark, sf).select("id", "o_orderkey", "status", F.col("created_ts").alias("changed"))
    later = (first.join(orders, "o_orderkey").where(F.col("o_orderstatus") == "F")
             .select("id", "o_orderkey", F.lit("closed").alias("status"),
                     (F.col("changed") + F.expr("interval 1 hour")).alias("changed")))
    return first.unionByName(later)


@query("upsert_latest", BASE + """
select d.id, case when o.o_orderstatus = 'F' then 'closed' else d.status end as status
from raw_deliveries d join orders o on d.o_orderkey = o.o_orderkey""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return changes.upsert_latest(_status_changes(spark, sf), "id", ["changed"]).select("id", "status")


@query("streamed_upserts", BASE + """
select d.id, case when o.o_orderstatus = 'F' then 'closed' else d.status end as status
from raw_deliveries d join orders o on d.o_orderkey = o.o_orderkey""")
def streamed_upserts(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "upserts")
    _status_changes(spark, sf).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    options, trigger = readers.flush_policy(max_files=2, available_now=True)
    feed = spark.readStream.schema(schema).options(**options).parquet(f"{root}/in")
    jobs.start_upserts(feed, f"{root}/log", f"{root}/state", "id", ["changed"], trigger).awaitTermination()
    state = changes.upsert_latest(spark.read.parquet(f"{root}/log"), "id", ["changed"])
    return state.select("id", "status")


@query("apply_deletes", BASE + """
select px.id, px.owner_name from px
where px.o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')""")
def apply_deletes(spark: SparkSession, sf: str) -> DataFrame:
    gone = (fx.delivery_rows(spark, sf).join(
        fx.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select("o_orderkey"), "o_orderkey")
        .select("id"))
    return changes.apply_deletes(fx.processed(spark, sf), gone).select("id", "owner_name")


@query("change_log_state", BASE + """
select px.id, px.owner_name from px
where px.o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')""")
def change_log_state(spark: SparkSession, sf: str) -> DataFrame:
    """Writes and deletes in one log; the newest entry per key decides."""
    rows = fx.processed(spark, sf).select("id", "owner_name", F.lit(1).alias("seq"))
    gone = (fx.delivery_rows(spark, sf).join(
        fx.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select("o_orderkey"), "o_orderkey")
        .select("id", F.lit(None).cast("string").alias("owner_name"), F.lit(2).alias("seq")))
    log = changes.as_changes(rows).unionByName(changes.as_changes(gone, changes.DELETE))
    return changes.current_rows(log, "id", ["seq"]).select("id", "owner_name")


@query("routed_collections", BASE + """
select 'deliveries' as collection, id from dl union all select 'alerts', id from al
union all select 'events', event_id from ev""")
def routed_collections(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "routing")
    docs = fx.deliveries(spark, sf).drop("vec_id", "street")
    event_docs = fx.events(spark, sf).drop("delivery_id", "event_ts")
    mixed = (changes.as_documents(docs, "deliveries")
             .unionByName(changes.as_documents(episodes.derive_alerts(docs), "alerts"))
             .unionByName(changes.as_documents(event_docs, "events")))
    mixed.write.parquet(f"{root}/in")
    feed = readers.stream_raw(spark, "mixed", f"{root}/in", max_files=8)
    jobs.start_routing(feed, root, f"{root}/state").awaitTermination()
    parts = [spark.read.schema(schemas.RAW[c]).parquet(f"{root}/{c}")
             .select(F.lit(c).alias("collection"), "id") for c in ("deliveries", "alerts", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("lookup_by_id", BASE + """
select id, owner_name, knowledge_summary from px
where id in (select delivery_id from al where severity = 'critical')""")
def lookup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    wanted = feeds.by_severity(_alerts(spark, sf), "critical").select(F.col("delivery_id").alias("id"))
    return joins.lookup_by_id(fx.processed(spark, sf), wanted).select("id", "owner_name", "knowledge_summary")


# ---- enrichment ---------------------------------------------------------------------------------

@query("pending_feed", BASE + """
select id, owner_name, carrier, scenario_type, risk_score, level as risk_level, created_at
from told order by created_at desc, id limit 20""")
def pending_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.recent_raw(en.pending_only(fx.deliveries(spark, sf)), 20)
    return rows.select("id", redact_name(F.col("owner_name")).alias("owner_name"), "carrier", "scenario_type",
                       "risk_score", risk_level(F.col("risk_score")).alias("risk_level"), "created_at")


@query("pending_only", BASE + "select id, processing_status from dl where processing_status = 'pending'")
def pending_only(spark: SparkSession, sf: str) -> DataFrame:
    return en.pending_only(fx.deliveries(spark, sf)).select("id", "processing_status")


@query("redacted_names", BASE + "select id, owner_name from told")
def redacted_names(spark: SparkSession, sf: str) -> DataFrame:
    return fx.processed(spark, sf).select("id", "owner_name")


@query("enriched_deliveries", BASE + f"""
select id, home_id, address, owner_name, status, scenario_type, carrier, delivery_location, risk_score,
  created_at, event_ids, timeline, factors_csv as risk_factors,
  case when status like 'completed%' then last_ts end as actual_delivery_time,
  strftime(created_ts - interval '4' hour, {ISO}) as expected_window_start,
  strftime(created_ts - interval '1' hour, {ISO}) as expected_window_end,
  'processed' as processing_status, '{STAMP}' as processed_at, false as is_ai_ready,
  '2.0' as enrichment_version, 'rawdata' as source_scope, true as pii_redacted,
  knowledge_summary, embedding_text from px""")
def enriched_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    return fx.processed(spark, sf).select(
        "id", "home_id", "address", "owner_name", "status", "scenario_type", "carrier", "delivery_location",
        "risk_score", "created_at", _joined("event_ids"), _timeline_text().alias("timeline"),
        _joined("risk_factors"), "actual_delivery_time", "expected_window_start", "expected_window_end",
        "processing_status", "processed_at", "is_ai_ready", "enrichment_version", "source_scope",
        "pii_redacted", "knowledge_summary", "embedding_text")


@query("risk_assessments", BASE + """
select id, level, risk_score as score, array_to_string(factors, ',') as factors,
  array_to_string(recs, ';') as recommendations from px""")
def risk_assessments(spark: SparkSession, sf: str) -> DataFrame:
    ra = fx.processed(spark, sf).select("id", "risk_assessment.*")
    return ra.select("id", "level", "score", _joined("factors"),
                     F.array_join("recommendations", ";").alias("recommendations"))


@query("rejected_deliveries", BASE + """
select id, 'delivery_location is null' as reject_reason from dl
where processing_status = 'pending' and delivery_location = 'unknown'""")
def rejected_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries whose place is not known stand in for rows that cannot be enriched."""
    rows = fx.deliveries(spark, sf).withColumn("delivery_location", F.nullif("delivery_location", F.lit("unknown")))
    return en.reject_bad_rows(rows).select("id", "reject_reason")


@query("needs_embedding", BASE + """
select px.id, length(embedding_text) as n_chars from px
where not exists (select 1 from embeddings e where e.vec_id = px.vec_id and e.label = 0)""")
def needs_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries whose vector has label 0 count as embedded already."""
    done = fx.table(spark, sf, "embeddings").where("label = 0").select("vec_id", "embedding")
    rows = fx.processed(spark, sf).join(done, "vec_id", "left")
    return en.needs_embedding(rows).select("id", F.length("embedding_text").cast("bigint").alias("n_chars"))


# ---- episodes -----------------------------------------------------------------------------------

@query("assembled_deliveries", BASE + """
select dl.id as delivery_id, dl.home_id, dl.n_events, dl.event_ids, dl.timeline from dl""")
def assembled_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    rows = episodes.assemble_deliveries(fx.events(spark, sf))
    return rows.select("delivery_id", "home_id", F.col("n_events").cast("bigint").alias("n_events"),
                       _joined("event_ids"), _timeline_text().alias("timeline"))


@query("assembled_parts", BASE + """
select ev.delivery_id, ev.home_id, (ev.ord // 3)::int as part, count(*) as n_events,
  string_agg(event_id, ',' order by ord) as event_ids
from (select * replace (row_number() over (partition by delivery_id, home_id order by ts, event_id) - 1 as ord) from ev) ev
group by ev.delivery_id, ev.home_id, ev.ord // 3""")
def assembled_parts(spark: SparkSession, sf: str) -> DataFrame:
    """All events in parts of three, so that most episodes have several."""
    rows = episodes.assemble_deliveries(fx.events(spark, sf), part_events=3)
    return rows.select("delivery_id", "home_id", "part", F.col("n_events").cast("bigint").alias("n_events"), _joined("event_ids"))


@query("derived_alerts", BASE + """
select id, delivery_id, home_id, address, alert_type, severity, message, triggered_at,
  false as acknowledged, event_ids as related_event_ids from al""")
def derived_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _alerts(spark, sf).withColumn("related_event_ids", F.array_join("related_event_ids", ","))


@query("classified_scenarios", BASE + "select id as delivery_id, n_events, scenario_type from dl")
def classified_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.classify_scenario(fx.events(spark, sf))


@query("session_episodes", BASE + f"""
, gaps as (
  select *, event_ts > lag(event_ts) over w + interval '5' hour as breaks
  from raw_events window w as (partition by home_id order by event_ts, event_id)
), numbered as (
  select *, count(*) filter (where breaks) over (partition by home_id order by event_ts, event_id) as s from gaps
)
select home_id, strftime(min(event_ts), {ISO}) as first_event, strftime(max(event_ts), {ISO}) as last_event,
  count(*) as n_events,
  case when bool_or(event_type = 'unknown_person') then 'theft_suspicious'
    when bool_or(event_type = 'door_stuck') then 'door_stuck_open'
    when bool_or(event_type = 'package_not_detected') then 'no_package_placed'
    when bool_or(event_type = 'delivery_timeout') then 'delivery_timeout'
    when bool_or(event_type = 'package_detected' and location = 'behind_vehicle') then 'package_behind_car'
    when bool_or(event_type = 'delivery_confirmed') then 'happy_path'
    when bool_or(event_type = 'package_detected' and location = 'front_door') then 'front_door_misdelivery'
  end as scenario_type
from numbered group by home_id, s""")
def session_episodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = episodes.session_episodes(fx.events(spark, sf), 5 * 3600)
    return rows.withColumns({c: iso_time(F.col(c)) for c in ("first_event", "last_event")})


@query("streamed_sessions", BASE + f"""
, gaps as (
  select *, event_ts > lag(event_ts) over w + interval '5' hour as breaks
  from raw_events window w as (partition by home_id order by event_ts, event_id)
), numbered as (
  select *, count(*) filter (where breaks) over (partition by home_id order by event_ts, event_id) as s from gaps
)
select home_id, strftime(min(event_ts), {ISO}) as first_event, count(*) as n_events from numbered group by home_id, s
having max(event_ts) + interval '5' hour <= (select max(event_ts) - interval '10' minute from raw_events)""")
def streamed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "sessions")
    # a task reads at most 32 files (128 MB, a file counts 4 MB or more), so the sessions that it opens are bounded
    (fx.events(spark, sf).select("home_id", "event_ts", "type", "location")
     .write.option("maxRecordsPerFile", EVENTS_PER_FILE).parquet(f"{root}/in"))
    feed = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    jobs.append_table(jobs.stream_sessions(feed, "5 hours"), f"{root}/out", f"{root}/state").awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    return rows.select("home_id", iso_time(F.col("first_event")).alias("first_event"), "n_events")


@query("event_devices", BASE + """
select event_id, e.home_id, location, case
  when location = 'garage' then 'GDO-SEN-' || tail when location = 'front_door' then 'CAM-FRT-' || tail
  else 'CAM-GAR-' || tail end as device_id
from raw_events e join homes h on e.home_id = h.id""")
def event_devices(spark: SparkSession, sf: str) -> DataFrame:
    rows = sensors.assign_devices(fx.events(spark, sf), fx.homes(spark, sf))
    return rows.select(F.col("id").alias("event_id"), "home_id", "location", "device_id")


# ---- joins --------------------------------------------------------------------------------------

@query("redaction_audit", BASE + """
select dl.id, dl.created_at, dl.owner_name as raw_name, dl.address as raw_address,
  coalesce(px.owner_name, 'R*******') as shown_name, coalesce(px.address, 'N/A') as shown_address,
  px.id is not null as has_twin,
  coalesce(contains(px.owner_name, dl.owner_name) or contains(px.embedding_text, dl.owner_name), false) as name_leaked
from dl left join px on dl.id = px.id""")
def redaction_audit(spark: SparkSession, sf: str) -> DataFrame:
    return joins.redaction_audit(fx.deliveries(spark, sf), fx.processed(spark, sf))


@query("attach_home", BASE + """
select d.id, d.home_id, h.owner_name as home_owner,
  h.address || ', ' || h.city || ', ' || h.state || ' ' || h.zip_code as home_address
from raw_deliveries d join homes h on d.home_id = h.id""")
def attach_home(spark: SparkSession, sf: str) -> DataFrame:
    return joins.attach_home(fx.deliveries(spark, sf), fx.homes(spark, sf)).select(
        "id", "home_id", "home_owner", "home_address")


@query("delivery_events", BASE + """
select delivery_id, home_id, ord as pos, event_id, event_type, location, summary, ts as "timestamp" from ev""")
def delivery_events(spark: SparkSession, sf: str) -> DataFrame:
    return joins.explode_delivery_events(fx.deliveries(spark, sf))


@query("unprocessed", BASE + "select id from dl where processing_status <> 'pending'")
def unprocessed(spark: SparkSession, sf: str) -> DataFrame:
    return joins.unprocessed(fx.deliveries(spark, sf), fx.processed(spark, sf)).select("id")


@query("alert_context", BASE + """
select al.id, al.delivery_id, al.severity, dl.scenario_type, dl.status, dl.carrier, dl.risk_score,
  dl.delivery_location from al join dl on al.delivery_id = dl.id""")
def alert_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.alert_context(_alerts(spark, sf), fx.deliveries(spark, sf))
    return rows.select("id", "delivery_id", "severity", "scenario_type", "status", "carrier", "risk_score",
                       "delivery_location")


# ---- predicates ---------------------------------------------------------------------------------

@query("search_filter", VECTORS + """
select id, carrier, scenario_type, status, risk_score from ready
where carrier = 'UPS' and scenario_type = 'package_behind_car' and status = 'completed_risk'
  and risk_score >= 0.45 and risk_score < 0.75""")
def search_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.search_filter(fx.ai_ready(spark, sf), carrier="UPS", scenario="package_behind_car",
                               status="completed_risk", risk_level="high")
    return rows.select("id", "carrier", "scenario_type", "status", "risk_score")


@query("risk_bands", VECTORS + """
select 'critical' as band, id from ready where risk_score >= 0.75
union all select 'high', id from ready where risk_score >= 0.45 and risk_score < 0.75
union all select 'medium', id from ready where risk_score >= 0.2 and risk_score < 0.45
union all select 'low', id from ready where risk_score < 0.2
union all select 'none', id from ready""")
def risk_bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.ai_ready(spark, sf)
    hit = [F.when(feeds.search_predicate(risk_level=b), b) for b in ("critical", "high", "medium", "low", "none")]
    return (rows.select("id", F.explode(F.array(*hit)).alias("band")).where(F.col("band").isNotNull())
            .select("band", "id"))


@query("homeowner_alert_pool", BASE + "select id, risk_score from dl where risk_score >= 0.45")
def homeowner_alert_pool(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.homeowner_alert_pool(fx.deliveries(spark, sf)).select("id", "risk_score")


@query("one_of_scenario", BASE + """
select id, scenario_type, address from dl where scenario_type = 'package_behind_car' order by id limit 1""")
def one_of_scenario(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.by_scenario(fx.deliveries(spark, sf), "package_behind_car").select("id", "scenario_type", "address")


@query("alerts_of_severity", BASE + "select id, severity, message from al where severity = 'high'")
def alerts_of_severity(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.by_severity(_alerts(spark, sf), "high").select("id", "severity", "message")


# ---- feeds --------------------------------------------------------------------------------------

@query("recent_raw", BASE + """
select id, owner_name, address, status, created_at from dl order by created_at desc, id limit 20""")
def recent_raw(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.recent_raw(fx.deliveries(spark, sf)).select("id", "owner_name", "address", "status", "created_at")


@query("recent_processed", BASE + """
select id as doc_id, id, owner_name, address, status, scenario_type, carrier, risk_score, knowledge_summary,
  level as risk_level, delivery_location, false as is_ai_ready, created_at, 'processed' as processing_status
from px order by created_at desc, id limit 20""")
def recent_processed(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.recent_processed(fx.processed(spark, sf))
    return rows.withColumn("risk_level", F.col("risk_assessment.level")).drop("risk_assessment")


@query("recent_alerts", BASE + """
select id, severity, message, triggered_at from al where severity = 'critical'
order by triggered_at desc, id limit 20""")
def recent_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.recent_alerts(_alerts(spark, sf), "critical").select("id", "severity", "message", "triggered_at")


def _balanced_sql(n: int) -> str:
    per = max(n // 4, 3)
    return BASE + f""", r as (
  select *, row_number() over (partition by severity order by triggered_at desc, id) as rn from al)
select id, severity, triggered_at from r where rn <= {per}
order by triggered_at desc, case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 else 4 end, id
limit {n}"""


@query("balanced_alerts", _balanced_sql(10))
def balanced_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.balanced_alerts(_alerts(spark, sf), 10).select("id", "severity", "triggered_at")


@query("balanced_alerts_wide", _balanced_sql(50))
def balanced_alerts_wide(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.balanced_alerts(_alerts(spark, sf), 50).select("id", "severity", "triggered_at")


def _diverse_sql(group: str, total: int, pool: str = "dl") -> str:
    """Three passes spelled out as three sets: scenarios, then new addresses, then the rest."""
    return BASE + f""", items as (
  select {group} as g, id, scenario_type, address,
    row_number() over (partition by {group} order by created_at desc, id) as pos from {pool}
), short as (select * from items where pos <= 20
), one as (
  select g, scenario_type, min(pos) as pos from short group by g, scenario_type
), shown as (
  select distinct s.g, s.address from short s join one on s.g = one.g and s.pos = one.pos
), two as (
  select s.g, s.address, min(s.pos) as pos from short s
  where not exists (select 1 from shown x where x.g = s.g and x.address = s.address) group by s.g, s.address
), ordered as (
  select s.*, case when one.pos is not null then 1 when two.pos is not null then 2 else 3 end as pick_pass
  from short s left join one on s.g = one.g and s.pos = one.pos left join two on s.g = two.g and s.pos = two.pos
)
select g as list, id, cast(pick_pass as bigint) as pick_pass, pick from (
  select *, row_number() over (partition by g order by pick_pass, pos) as pick from ordered) where pick <= {total}"""


def _pick_columns(rows: DataFrame, group) -> DataFrame:
    return rows.select(group.alias("list"), "id", F.col("pick_pass").cast("bigint").alias("pick_pass"),
                       F.col("pick").cast("bigint").alias("pick"))


@query("diverse_feed", _diverse_sql("'fleet'", 6))
def diverse_feed(spark: SparkSession, sf: str) -> DataFrame:
    short = feeds.with_position(feeds.recent_raw(fx.deliveries(spark, sf), 20))
    return _pick_columns(feeds.diverse_pick(short, 6), F.lit("fleet"))


@query("diverse_feed_per_home", _diverse_sql("home_id", 6))
def diverse_feed_per_home(spark: SparkSession, sf: str) -> DataFrame:
    lists = feeds.recent_per_group(fx.deliveries(spark, sf), "home_id", 20)
    return _pick_columns(feeds.diverse_pick(lists, 6, "home_id"), F.col("home_id"))


@query("comparison_row", BASE + """
select id, scenario_type from dl where scenario_type = 'package_behind_car' order by id limit 1""")
def comparison_row(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.comparison_row(fx.deliveries(spark, sf)).select("id", "scenario_type")


@query("comparison_row_fallback", BASE + """
select id, scenario_type from dl order by created_at desc, id limit 1""")
def comparison_row_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.comparison_row(fx.deliveries(spark, sf), "no_such_scenario").select("id", "scenario_type")


@query("delivery_cards", BASE + f"""
select id, {title_sql('status')} as status_label,
  case when risk_score >= 0.75 then 'critical' when risk_score >= 0.45 then 'risk' else 'safe' end as tier,
  {percent_sql('risk_score')} || case when risk_score >= 0.75 then ' CRITICAL' when risk_score >= 0.45 then ' RISK'
    else ' Safe' end as risk_label,
  strftime(created_ts, '%H:%M') as time, {SHORT_SQL} as summary, {NAME_SQL} as scenario,
  {title_sql('delivery_location')} as location, carrier from dl""")
def delivery_cards(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.delivery_cards(fx.deliveries(spark, sf))


@query("homeowner_feed", _diverse_sql("home_id", 6).replace("select g as list, id,", """
select g as home_id, (select """ + SHORT_SQL + """ from dl where dl.id = z.id) as summary, id,""").replace(
    "as pick from ordered) where", "as pick from ordered) z where").replace(
    "cast(pick_pass as bigint) as pick_pass, ", ""))
def homeowner_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Per home: newest twenty, diverse six, as cards."""
    lists = feeds.recent_per_group(fx.deliveries(spark, sf), "home_id", 20)
    picked = feeds.diverse_pick(lists, 6, "home_id").withColumn("pick", F.col("pick").cast("bigint"))
    return feeds.delivery_cards(picked, "home_id", "pick").select("home_id", "summary", "id", "pick")


@query("homeowner_alert_cards", BASE + f"""
select id, {NAME_SQL} || ' — ' || address as title,
  coalesce(recs[1], 'Check your security camera.') as advice,
  case when status = 'suspicious' then 'critical' else 'warning' end as banner,
  {percent_sql('risk_score')} || ' RISK' as risk_label, carrier
from dl where risk_score >= 0.45""")
def homeowner_alert_cards(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.homeowner_alert_cards(feeds.homeowner_alert_pool(fx.deliveries(spark, sf)))


@query("comparison_cards", BASE + f"""
select id, case when risk_score >= 0.45 then 'Smart Delivery Alert' else 'Smart Delivery Update' end as title,
  case scenario_type
  when 'happy_path' then 'Your ' || carrier || ' package was safely delivered inside your garage. Analyzed ' || n_events || ' sensor events — door opened, package confirmed, door closed and locked. No risk factors detected. No action needed.'
  when 'front_door_misdelivery' then carrier || ' left your package at the front door instead of the garage. Analyzed ' || n_events || ' sensor events — camera detected package outside, not in the secure garage zone. Risk: exposed to weather and theft (' || {percent_sql('risk_score')} || '). Retrieve your package or enable garage-only delivery.'
  when 'package_behind_car' then 'Your ' || carrier || ' package was placed behind your car in the garage — it could be crushed when you back out. Analyzed ' || n_events || ' sensor events — camera confirmed package near vehicle. Move the package before driving (' || {percent_sql('risk_score')} || ' risk).'
  when 'door_stuck_open' then 'Your garage door is stuck open after ' || carrier || ' delivery. Package was placed inside, but the door failed to close — garage is unsecured and exposed to weather and intruders. Analyzed ' || n_events || ' events over 10+ minutes with no door-close signal. Immediate action required (' || {percent_sql('risk_score')} || ' risk).'
  when 'no_package_placed' then 'Garage door opened for ' || carrier || ' but no package was detected inside. Analyzed ' || n_events || ' sensor events — motion was detected but camera confirmed no package in the garage zone. Possible missed delivery or wrong drop-off location (' || {percent_sql('risk_score')} || ' risk).'
  when 'delivery_timeout' then 'Your expected ' || carrier || ' delivery never arrived. Monitored for the full delivery window with only ' || n_events || ' events — no carrier activity, no person detected, no package placed. Contact ' || carrier || ' for a status update.'
  else 'An unknown person was detected near your ' || carrier || ' package at the front door minutes after delivery. Analyzed ' || n_events || ' sensor events — camera flagged a second person after the driver left. Package may be at risk of theft (' || {percent_sql('risk_score')} || ' risk). Check your camera immediately.'
  end as insight,
  case when risk_score >= 0.75 then 'Critical' when risk_score >= 0.45 then 'At Risk' else 'Safe' end as safety,
  {title_sql('delivery_location')} as location, carrier, 'Risk: ' || {percent_sql('risk_score')} as risk_label
from dl""")
def comparison_cards(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.comparison_cards(fx.deliveries(spark, sf))


@query("door_card", BASE + f"""
select case when scenario_type = 'door_stuck_open' then 'Stuck Open' else 'Closed' end as door,
  'Latest: ' || carrier || ' delivery at ' || address || ' — ' || {SHORT_SQL} as banner
from dl order by created_at desc, id limit 1""")
def door_card(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.door_card(fx.deliveries(spark, sf))


@query("alert_cards", BASE + f"""
select id, severity, {title_sql('alert_type')} as alert_label, substr(triggered_at, 12, 5) as time,
  address || ' — ' || case when length(message) > 80 then left(message, 80) || '...' else message end as text from al""")
def alert_cards(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.alert_cards(_alerts(spark, sf))


# ---- counts -------------------------------------------------------------------------------------

@query("collection_counts", BASE + """
select 'homes' as collection, count(*) as row_count from homes union all select 'events', count(*) from raw_events
union all select 'deliveries', count(*) from dl union all select 'alerts', count(*) from al
union all select 'processed', count(*) from px union all select 'archive', 0""")
def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.collection_counts({
        "homes": fx.homes(spark, sf), "events": fx.events(spark, sf), "deliveries": fx.deliveries(spark, sf),
        "alerts": _alerts(spark, sf), "processed": fx.processed(spark, sf), "archive": None})


@query("ai_ready_count", BASE + """
select count(*) as ai_ready from px join embeddings e on px.vec_id = e.vec_id""")
def ai_ready_count(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ai_ready_count(fx.ai_ready(spark, sf))


@query("ai_ready_rows", BASE + "select px.id from px join embeddings e on px.vec_id = e.vec_id")
def ai_ready_rows(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.ai_ready(fx.ai_ready(spark, sf)).select("id")


@query("processing_progress", BASE + """
select raw_count, processed_count, cast(processed_count as double) / raw_count * 100 as percent
from (select count(*) as raw_count, count(*) filter (where processing_status = 'pending') as processed_count from dl)""")
def processing_progress(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.processing_progress(fx.deliveries(spark, sf), fx.processed(spark, sf))


@query("status_distribution", BASE + """
select status, count(*) as deliveries, round(cast(count(*) as double) / (select count(*) from dl) * 100, 6) as percent
from dl group by status""")
def status_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.status_distribution(fx.deliveries(spark, sf))
    return rows.withColumn("percent", F.round("percent", 6))


@query("risk_distribution", BASE + """
select count(*) filter (where level = 'critical') as critical, count(*) filter (where level = 'high') as high,
  count(*) filter (where level = 'medium') as medium, count(*) filter (where level = 'low') as low from dl""")
def risk_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.risk_distribution(fx.deliveries(spark, sf))


@query("distinct_carriers", BASE + "select distinct carrier from dl order by carrier")
def distinct_carriers(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.distinct_sorted(fx.deliveries(spark, sf), "carrier")


@query("distinct_scenarios", BASE + "select distinct scenario_type from dl order by scenario_type")
def distinct_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.distinct_sorted(fx.deliveries(spark, sf), "scenario_type")


@query("top_risk_factors", BASE + """
, f as (
  select id, unnest(factors) as factor, generate_subscripts(factors, 1) as pos from dl
), c as (
  select factor, count(*) as occurrences, min(printf('%s/%04d', id, pos)) as first_seen from f group by factor
)
select factor, occurrences from c order by occurrences desc, first_seen limit 5""")
def top_risk_factors(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_risk_factors(fx.deliveries(spark, sf), ["id"])


@query("fleet_overview", BASE + """
select (select count(*) from homes) as homes, (select count(*) from dl) as deliveries,
  (select count(*) from al) as alerts, (select count(*) from px) as processed,
  (select count(*) from px join embeddings e on px.vec_id = e.vec_id) as ai_ready""")
def fleet_overview(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fleet_overview(fx.homes(spark, sf), fx.deliveries(spark, sf), _alerts(spark, sf),
                                  fx.ai_ready(spark, sf))


@query("pattern_groups", BASE + """
, f as (
  select scenario_type, carrier, factor, count(*) as n
  from (select scenario_type, carrier, unnest(factors) as factor from dl) group by all
)
select d.scenario_type, d.carrier, d.deliveries, d.mean_risk,
  (select string_agg(factor, ',' order by n desc, factor) from f
   where f.scenario_type = d.scenario_type and f.carrier = d.carrier) as shared_factors
from (select scenario_type, carrier, count(*) as deliveries, round(avg(risk_score), 6) as mean_risk
      from dl group by all) d""")
def pattern_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.pattern_groups(fx.deliveries(spark, sf))
    return rows.select("scenario_type", "carrier", "deliveries", F.round("mean_risk", 6).alias("mean_risk"),
                       F.array_join("shared_factors", ",").alias("shared_factors"))


@query("index_ready", BASE + """
select count(*) as ai_ready, count(*) >= 200 as ready from px join embeddings e on px.vec_id = e.vec_id""")
def index_ready(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.index_ready(fx.ai_ready(spark, sf))


# ---- throughput ---------------------------------------------------------------------------------

def _live_feed(spark: SparkSession, sf: str, stream: bool = False) -> DataFrame:
    """The supplied event stream as a mixed ingest feed: errors as alerts, purchases as deliveries."""
    batch = fx.table(spark, sf, "events")
    rows = batch if not stream else (
        spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf))
    kind = (F.when(F.col("event_type") == "error", "alerts")
            .when(F.col("event_type") == "purchase", "deliveries").otherwise("events"))
    return rows.select(fx.iso_text(F.col("ts")).cast("timestamp").alias("ingest_ts"), kind.alias("collection"))


TICKS_SQL = """
with t as (
  select date_trunc('second', ts) as tick, count(*) filter (where event_type not in ('error', 'purchase')) as e,
    count(*) filter (where event_type = 'purchase') as d, count(*) filter (where event_type = 'error') as a
  from events group by 1
)"""
THROUGHPUT_SQL = f"""
select strftime(tick, {ISO}) as tick, cast(e as double) as actual_rate,
  cast(sum(e) over w as bigint) as total_events_ingested, cast(sum(d) over w as bigint) as total_deliveries,
  cast(sum(a) over w as bigint) as total_alerts,
  cast(date_diff('second', min(tick) over (), tick) + 1 as double) as elapsed_seconds,
  round(sum(e) over w / (date_diff('second', min(tick) over (), tick) + 1), 6) as mean_rate
from t {{closed}} window w as (order by tick)"""


@query("throughput", TICKS_SQL + THROUGHPUT_SQL.format(closed=""))
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.throughput(metrics.tick_counts(_live_feed(spark, sf)))
    return rows.withColumns({"tick": iso_time(F.col("tick")), "mean_rate": F.round("mean_rate", 6)})


CLOSED = "where tick + interval '1' second <= (select max(ts) - interval '10' second from events)"


@query("streamed_metrics", TICKS_SQL + f"""
select cast(sum(e) over w as bigint) as total_events_ingested, cast(sum(d) over w as bigint) as total_deliveries,
  cast(sum(a) over w as bigint) as total_alerts, cast(5000 as bigint) as target_rate, cast(e as double) as actual_rate,
  strftime(min(tick) over (), {ISO}) as start_time, strftime(tick, {ISO}) as last_update, true as running,
  cast(date_diff('second', min(tick) over (), tick) + 1 as double) as elapsed_seconds,
  cast(50 as bigint) as workers, cast(200 as bigint) as batch_size
from t {CLOSED} window w as (order by tick)""")
def streamed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Closed ticks of the stream, then the metrics document of each."""
    root = scratch_dir(spark, "metrics")
    jobs.start_metrics(_live_feed(spark, sf, stream=True), f"{root}/ticks", f"{root}/state").awaitTermination()
    docs = jobs.metrics_documents(metrics.throughput(spark.read.parquet(f"{root}/ticks")), 5000, 50, 200)
    return docs.withColumns({c: F.col(c).cast("bigint") for c in ("target_rate", "workers", "batch_size")})


# ---- sensors, places, free text -----------------------------------------------------------------

@query("redact_patterns", BASE + r"""
select id, email_hits, phone_hits, ssn_hits,
  regexp_replace(regexp_replace(regexp_replace(note, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[SSN]', 'g'),
    '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[EMAIL]', 'g'),
    '\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b', '[PHONE]', 'g') as note
from (
  select id, note, len(regexp_extract_all(note, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) as ssn_hits,
    len(regexp_extract_all(note, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) as email_hits,
    len(regexp_extract_all(note, '\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b')) as phone_hits
  from (select id, message || ' Owner ' || owner || case o_orderkey % 3 when 0 then ' at ' || lower(replace(owner, ' ', '.')) || '@example.com'
      when 1 then ' on ' || phone else ' with ' || ssn end as note from (
    select al.id, al.message, dl.owner_name as owner, dl.o_orderkey, '555-010-' || lpad(cast(dl.o_orderkey % 10000 as varchar), 4, '0') as phone,
      '000-12-' || lpad(cast(dl.o_orderkey % 10000 as varchar), 4, '0') as ssn
    from al join dl on al.delivery_id = dl.id)))""")
def redact_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Alert notes with the owner's contact data in them, as an operator might type them."""
    number = F.col("id").substr(5, 8).cast("bigint")
    tail = F.lpad((number % 10000).cast("string"), 4, "0")
    contact = (F.when(number % 3 == 0, F.concat(F.lit(" at "), F.lower(F.replace("owner_name", F.lit(" "), F.lit("."))), F.lit("@example.com")))
               .when(number % 3 == 1, F.concat(F.lit(" on 555-010-"), tail)).otherwise(F.concat(F.lit(" with 000-12-"), tail)))
    owners = fx.deliveries(spark, sf).select(F.col("id").alias("delivery_id"), "owner_name", contact.alias("contact"))
    notes = _alerts(spark, sf).join(owners, "delivery_id").select(
        "id", F.concat("message", F.lit(" Owner "), "owner_name", "contact").alias("note"))
    rows = privacy.redact_patterns(notes, "note")
    return rows.select("id", "note", *[F.col(f"{k}_hits").cast("bigint").alias(f"{k}_hits") for k in privacy.PATTERNS])


@query("redacted_documents", r"""
select doc_id, len(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) as ssn_hits,
  len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) as email_hits,
  len(regexp_extract_all(text, '\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b')) as phone_hits,
  md5(regexp_replace(regexp_replace(regexp_replace(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[SSN]', 'g'),
    '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[EMAIL]', 'g'),
    '\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b', '[PHONE]', 'g')) as text_md5
from (select doc_id, coalesce(text, '') as text from documents)""")
def redacted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Contact data masked in the whole texts of the document corpus."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = privacy.redact_patterns(docs, "text")
    return rows.select("doc_id", *[F.col(f"{k}_hits").cast("bigint").alias(f"{k}_hits") for k in privacy.PATTERNS],
                       F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("geo_tags", BASE + """
select d.id, h.latitude, h.longitude, cast(floor(h.latitude / 0.05) as bigint) as lat_cell,
  cast(floor(h.longitude / 0.05) as bigint) as lon_cell from raw_deliveries d join homes h on d.home_id = h.id""")
def geo_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = sensors.geo_tag(fx.deliveries(spark, sf), fx.homes(spark, sf))
    return rows.select("id", "latitude", "longitude", "lat_cell", "lon_cell")


@query("deliveries_per_cell", BASE + """
select cast(floor(h.latitude / 0.05) as bigint) as lat_cell, cast(floor(h.longitude / 0.05) as bigint) as lon_cell,
  count(*) as deliveries, round(avg(d.risk_score), 6) as mean_risk
from raw_deliveries d join homes h on d.home_id = h.id group by all""")
def deliveries_per_cell(spark: SparkSession, sf: str) -> DataFrame:
    rows = sensors.deliveries_per_cell(sensors.geo_tag(fx.deliveries(spark, sf), fx.homes(spark, sf)))
    return rows.withColumn("mean_risk", F.round("mean_risk", 6))


@query("sensor_rollup", BASE + """
, r as (
  select e.home_id, case when location = 'garage' then 'GDO-SEN-' || tail
      when location = 'front_door' then 'CAM-FRT-' || tail else 'CAM-GAR-' || tail end as device_id,
    case when event_type in ('camera_motion', 'person_detected', 'unknown_person') then 0.75 + (n % 25) / 100.0 end as motion,
    case when event_type in ('camera_motion', 'person_detected', 'unknown_person', 'package_detected')
      then 0.85 + (n % 7) / 100.0 end as label_conf,
    -30 - n % 40 as signal
  from raw_events e join homes h on e.home_id = h.id
)
select home_id, device_id, count(*) as events, round(avg(cast(motion as double)), 6) as mean_motion,
  round(avg(cast(label_conf as double)), 6) as mean_classification, round(avg(cast(signal as double)), 6) as mean_signal,
  '3.2.1' as firmware from r group by home_id, device_id""")
def sensor_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = sensors.sensor_rollup(sensors.assign_devices(fx.events(spark, sf), fx.homes(spark, sf)))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_motion", "mean_classification", "mean_signal")})


@query("door_dwell", BASE + """
, nx as (
  select home_id, event_type, event_ts, lead(event_type) over w as next_type, lead(event_ts) over w as next_ts
  from raw_events where event_type in ('door_open', 'door_close', 'door_stuck')
  window w as (partition by home_id order by event_ts, event_id)
)
select home_id, count(*) as opened, count(*) filter (where next_type = 'door_close') as closed,
  round(avg(case when next_type = 'door_close' then date_diff('second', event_ts, next_ts) end), 6) as mean_open_seconds
from nx where event_type = 'door_open' group by home_id""")
def door_dwell(spark: SparkSession, sf: str) -> DataFrame:
    rows = sensors.door_dwell(fx.events(spark, sf))
    return rows.withColumn("mean_open_seconds", F.round("mean_open_seconds", 6))


# ---- vectors ------------------------------------------------------------------------------------

def _question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _question(spark: SparkSession, sf: str) -> list[float]:
    """One question vector, the way a search box hands one over: that of the smallest id."""
    return fx.table(spark, sf, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


@query("embedded_deliveries")
def embedded_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors.embed(en.needs_embedding(fx.processed(spark, sf)), generated_at=F.lit(STAMP))
    return rows.select("id", "is_ai_ready", "embedding_model", "embedding_dimensions", "embedding")


@query("cosine_distances", """
with v as (select vec_id, embedding::double[] as a from embeddings)
select v.vec_id, round(1 - list_cosine_similarity(v.a, w.a), 6) as distance
from v join v w on w.vec_id = v.vec_id + 1""")
def cosine_distances(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return rows.join(after, "vec_id").select(
        "vec_id", F.round(cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


def _topk_sql(k: int, where: str = "true") -> str:
    return VECTORS + f""", q as (select embedding::double[] as qv from embeddings order by vec_id limit 1),
scored as (
  select ready.*, round(1 - list_cosine_similarity(vec, qv), 9) as dist from ready, q where {where}
), hits as (
  select *, row_number() over (order by dist, id) as rank from scored order by dist, id limit {k}
)"""


@query("filtered_topk", _topk_sql(10, "risk_score >= 0.45 and risk_score < 0.75") + """
select id as doc_id, id, owner_name, address, status, scenario_type, knowledge_summary, level as risk_level,
  carrier, risk_score, delivery_location, timeline, factors_csv as risk_factors, round(1 - dist, 6) as score from hits""")
def filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = vectors.filtered_topk(fx.ai_ready(spark, sf), _question(spark, sf), 10, risk_level="high")
    return feeds.search_projection(hits).select(
        "doc_id", "id", "owner_name", "address", "status", "scenario_type", "knowledge_summary",
        F.col("risk_assessment.level").alias("risk_level"), "carrier", "risk_score", "delivery_location",
        _timeline_text().alias("timeline"), _joined("risk_factors"), "score")


@query("search_cards", _topk_sql(50) + f"""
select rank, id, {NAME_SQL} as scenario, printf('%.4f', round(1 - dist, 6)) as score_label,
  case when length(knowledge_summary) > 250 then left(knowledge_summary, 250) || '...' else knowledge_summary end as summary,
  carrier, address, {percent_sql('risk_score')} as risk_label,
  case when risk_score < 0.2 then 'success' when risk_score < 0.75 then 'risk' else 'failed' end as badge,
  owner_name, {spaced_sql('status')} as status_label from hits""")
def search_cards(spark: SparkSession, sf: str) -> DataFrame:
    hits = vectors.with_rank(vectors.filtered_topk(fx.ai_ready(spark, sf), _question(spark, sf), 50))
    cards = feeds.search_cards(hits)
    return cards.withColumn("rank", F.col("rank").cast("bigint"))


# all questions against all deliveries; vectors repeat, so distances are computed per vector pair
MANY = VECTORS + """
, pairs as (
  select q.vec_id as query_id, c.vec_id, round(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as dist
  from embeddings q, embeddings c
), ranked as (
  select p.query_id, r.id, p.dist, row_number() over (partition by p.query_id order by p.dist, r.id) as rank
  from pairs p join (select id, vec_id from ready) r on p.vec_id = r.vec_id
), best as (select * from ranked where rank <= {k})
"""


@query("topk_batch", MANY.replace("{k}", "10") + """
select query_id, id, round(dist, 6) as distance, rank, round(1 - dist, 6) as score from best""")
def topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    corpus = fx.ready_vectors(spark, sf).select("id", "embedding")
    hits = vectors.topk_batch(_question_vectors(spark, sf), corpus, 10)
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"),
                       F.col("rank").cast("bigint").alias("rank"), "score")


def _cells(spark: SparkSession, sf: str):
    corpus = fx.ready_vectors(spark, sf)
    model = vectors.train_cells(corpus, 16)
    path = scratch_dir(spark, "cells")
    vectors.write_cells(vectors.assign_cells(corpus, model), path)
    return spark.read.parquet(path), model


@query("ann_topk")
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    cells, model = _cells(spark, sf)
    hits = vectors.ann_topk(cells, model, _question(spark, sf), 10, nprobe=12)
    wide = fx.processed(spark, sf).select("id", "address", "knowledge_summary")
    return hits.join(wide, "id").select("id", "scenario_type", "address", "knowledge_summary", "distance", "score")


@query("ann_recall")
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the cell search per number of probed cells, over all questions."""
    cells, model = _cells(spark, sf)
    return vectors.recall_by_probes(_question_vectors(spark, sf), cells, model, 10, [4, 8, 12])


@query("sq8_topk")
def sq8_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.ai_ready(spark, sf)
    lo, hi = vectors.sq8_ranges(fx.table(spark, sf, "embeddings"))
    coded = vectors.sq8_quantize(rows, lo, hi)
    return vectors.sq8_topk(coded, _question(spark, sf), lo, hi, 10).select("id", "rough", "distance", "score")


# ---- question contexts --------------------------------------------------------------------------

def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Eight hits for every question vector, with the delivery columns of each.

    The hits are stored, so that only deliveries that were found are made into documents and travel to the join.
    """
    corpus = fx.ready_vectors(spark, sf).select("id", "embedding")
    path = scratch_dir(spark, "hits")
    vectors.topk_batch(_question_vectors(spark, sf), corpus, 8).write.parquet(path)
    best = spark.read.parquet(path)
    return best.join(fx.ai_ready(spark, sf, best.select("id")).select(*feeds.SEARCH_RESULT), "id")


HITS = MANY.replace("{k}", "8") + f"""
, hits as (select b.query_id, b.rank, px.* from best b join px on b.id = px.id
), mark as (
  select delivery_id, ord, ts, lag(event_ts) over (partition by delivery_id order by ord) as before, event_ts,
    summary, location, event_type from ev
), lines as (
  select delivery_id, string_agg('  [' || strftime(event_ts, '%H:%M')
    || case when date_diff('second', before, event_ts) >= 60
         then ' +' || (date_diff('second', before, event_ts) // 60) || 'm' else '' end
    || '] ' || summary || ' @ ' || location || ' (' || event_type || ')', chr(10) order by ord) as lines
  from mark where ord < 8 group by delivery_id
), blocks as (
  select query_id, rank, id, chr(10) || '--- Delivery ' || rank || ': ' || id || ' ---' || chr(10)
    || 'Scenario: ' || {spaced_sql('scenario_type')} || ' | Status: ' || {spaced_sql('status')}
    || ' | Carrier: ' || carrier || chr(10) || 'Address: ' || address || ' | Location: '
    || {spaced_sql('delivery_location')} || chr(10) || 'Owner: ' || owner_name || ' (redacted)' || chr(10)
    || 'Risk: ' || {percent_sql('risk_score')} || ' [' || level || ']' || chr(10)
    || 'Risk Factors: ' || case when factors_csv = '' then 'none'
         else {spaced_sql("replace(factors_csv, ',', ', ')")} end || chr(10)
    || 'Event Timeline:' || chr(10) || lines || chr(10)
    || 'Intelligence: ' || knowledge_summary || chr(10)
    || case when len(recs) > 0 then 'Recommendations: ' || array_to_string(recs, '; ') || chr(10) else '' end as block
  from hits join lines on hits.id = lines.delivery_id
), ff as (
  select query_id, factor, count(*) as n, min(rank * 100 + pos) as first from (
    select query_id, rank, unnest(factors) as factor, generate_subscripts(factors, 1) as pos from hits) group by all
), ft as (
  select query_id, string_agg({spaced_sql('factor')}, ', ' order by n desc, first) as top from (
    select *, row_number() over (partition by query_id order by n desc, first) as r from ff) where r <= 5 group by query_id
), heads as (
  select h.query_id, 'FLEET SUMMARY: ' || count(*) || ' deliveries retrieved by semantic similarity' || chr(10)
    || 'Risk distribution: ' || count(*) filter (where level = 'critical') || ' critical, '
    || count(*) filter (where level = 'high') || ' high, ' || count(*) filter (where level = 'medium') || ' medium, '
    || count(*) filter (where level = 'low') || ' low' || chr(10)
    || 'Carriers: ' || array_to_string(list_sort(list(distinct carrier)), ', ') || chr(10)
    || 'Scenarios: ' || array_to_string(list_sort(list(distinct {spaced_sql('scenario_type')})), ', ') || chr(10)
    || 'Common risk factors: ' || coalesce(max(ft.top), 'none') || chr(10) as summary
  from hits h left join ft on h.query_id = ft.query_id group by h.query_id
), ctx as (
  select h.query_id, max(h.summary) || chr(10) || string_agg(b.block, chr(10) order by b.rank) as context
  from heads h join blocks b on h.query_id = b.query_id group by h.query_id
)
"""


@query("fleet_summaries", HITS + "select query_id, summary from heads")
def fleet_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return rag.fleet_summary(_hits(spark, sf))


@query("timeline_texts", BASE + """
, mark as (
  select *, lag(event_ts) over (partition by delivery_id order by ord) as before from ev)
select delivery_id as id, string_agg('  [' || strftime(event_ts, '%H:%M')
    || case when date_diff('second', before, event_ts) >= 60
         then ' +' || (date_diff('second', before, event_ts) // 60) || 'm' else '' end
    || '] ' || summary || ' @ ' || location || ' (' || event_type || ')', chr(10) order by ord) as timeline
from mark where ord < 8 group by delivery_id""")
def timeline_texts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.deliveries(spark, sf).select("id", rag.format_timeline(F.col("event_timeline")).alias("timeline"))


@query("delivery_blocks", HITS + "select query_id, rank, id, block from blocks")
def delivery_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return rag.delivery_blocks(_hits(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("question_contexts", HITS + "select query_id, context from ctx")
def question_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return rag.context(_hits(spark, sf))


@query("prompt_rows", HITS + f"""
select e.vec_id as query_id, 'system' as role1, '{rag.SYSTEM_TEXT}' as content1, 'user' as role2,
  'Context from knowledge base:' || chr(10) || coalesce(ctx.context, '') || chr(10) || chr(10)
    || 'User question: What patterns exist around label ' || e.label || '?' as content2
from embeddings e left join ctx on e.vec_id = ctx.query_id""")
def prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    questions = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("What patterns exist around label "), F.col("label").cast("string"), F.lit("?")).alias("question"))
    rows = rag.prompt_rows(rag.context(_hits(spark, sf)), questions)
    say = lambda i, f: F.col("messages")[i][f]
    return rows.select("query_id", say(0, "role").alias("role1"), say(0, "content").alias("content1"),
                       say(1, "role").alias("role2"), say(1, "content").alias("content2"))


@query("source_lines", HITS + f"""
select query_id, rank, 'Delivery ' || rank || ': ' || {NAME_SQL} || ' | ' || carrier || ' | Risk: '
  || {percent_sql('risk_score')} || ' | ' || owner_name || ' at ' || address as source from hits""")
def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rag.source_lines(_hits(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))
