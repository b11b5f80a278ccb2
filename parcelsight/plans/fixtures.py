"""The supplied tables seen as homes, sensor events, deliveries and alerts (see FIXTURES.md).

The same WITH text runs in both engines, so the queries and their oracles start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelsight.functions import episode
from parcelsight.operators.enrich import enrich
from parcelsight.operators.vectors import index_rows

# Per scenario the bucket bound (percent), status, place, score range, factors, alert.
SCENARIOS = [
    ("happy_path", 60, "completed_success", "garage_inside", 0, 5, "", ""),
    ("front_door_misdelivery", 72, "completed_risk", "front_door", 45, 70,
     "package_wrong_location,not_in_garage,exposure_to_weather", "misdelivery"),
    ("package_behind_car", 80, "completed_risk", "behind_vehicle", 60, 85,
     "package_behind_vehicle,crush_risk,driver_may_not_see", "package_at_risk"),
    ("door_stuck_open", 86, "failed", "garage_inside", 75, 95,
     "door_stuck_open,security_risk,weather_exposure,garage_accessible", "door_stuck"),
    ("no_package_placed", 92, "failed", "unknown", 50, 70,
     "no_package_detected,door_opened_unnecessarily,possible_missed_delivery", "no_package"),
    ("delivery_timeout", 97, "failed", "unknown", 30, 50,
     "delivery_not_received,window_expired,no_carrier_activity", "delivery_timeout"),
    ("theft_suspicious", 100, "suspicious", "front_door", 85, 98,
     "package_theft_risk,unknown_person_detected,package_may_be_stolen,"
     "suspicious_activity_after_delivery", "theft_risk"),
]
# Per scenario the events as (type, place, seconds after the start).
TEMPLATE = {
    "happy_path": [
        ("delivery_window_start", "garage", 0), ("person_detected", "driveway", 1800),
        ("door_open", "garage", 1810), ("camera_motion", "garage", 1812),
        ("package_detected", "garage", 1828), ("door_close", "garage", 1838),
        ("delivery_confirmed", "garage", 1840)],
    "front_door_misdelivery": [
        ("delivery_window_start", "garage", 0), ("person_detected", "driveway", 2400),
        ("camera_motion", "front_door", 2430), ("package_detected", "front_door", 2440)],
    "package_behind_car": [
        ("delivery_window_start", "garage", 0), ("person_detected", "driveway", 3000),
        ("door_open", "garage", 3010), ("camera_motion", "garage", 3012),
        ("package_detected", "behind_vehicle", 3026), ("door_close", "garage", 3044)],
    "door_stuck_open": [
        ("delivery_window_start", "garage", 0), ("person_detected", "driveway", 3600),
        ("door_open", "garage", 3610), ("camera_motion", "garage", 3612),
        ("package_detected", "garage", 3626), ("door_stuck", "garage", 4376)],
    "no_package_placed": [
        ("delivery_window_start", "garage", 0), ("person_detected", "driveway", 4200),
        ("door_open", "garage", 4210), ("camera_motion", "garage", 4212),
        ("package_not_detected", "garage", 4257), ("door_close", "garage", 4267)],
    "delivery_timeout": [
        ("delivery_window_start", "garage", 0), ("delivery_window_end", "garage", 14400),
        ("delivery_timeout", "garage", 15750)],
    "theft_suspicious": [
        ("delivery_window_start", "garage", 0), ("person_detected", "driveway", 5400),
        ("camera_motion", "front_door", 5430), ("package_detected", "front_door", 5440),
        ("camera_motion", "front_door", 6490), ("unknown_person", "front_door", 6493)],
}


def iso_text(ts) -> Column:
    """A timestamp without zone as UTC text; independent of the session's zone."""
    return F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _values(rows) -> str:
    return ",\n    ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in rows)


# one number in twenty names no vector, so that some deliveries stay without one
VECTOR_NUMBERS = "(select count(*) + count(*) // 20 + 1 from embeddings)"


def fixture_sql(orders: str = "orders", customer: str = "customer", vector_numbers: str = VECTOR_NUMBERS) -> str:
    """WITH prefix that defines raw_deliveries, raw_events and homes. Vectors are dealt over all of `embeddings`."""
    scen = _values((s, st, place, lo, hi, fac, al) for s, _, st, place, lo, hi, fac, al in SCENARIOS)
    tmpl = _values((s, i, *e) for s, events in TEMPLATE.items() for i, e in enumerate(events))
    buckets = " ".join(f"when bucket < {bound} then '{s}'" for s, bound, *_ in SCENARIOS)
    return f"""
with scen as (
  select * from (values {scen})
  as t(scenario_type, status, delivery_location, lo, hi, factors_csv, alert_type)
), pick as (
  select b.*, case {buckets} end as scen from (
    select o.*, c.c_name, (o_orderkey * 7919) % 100 as bucket
    from {orders} o join {customer} c on o.o_custkey = c.c_custkey) b
), raw_deliveries as (
  select concat('del-', lpad(cast(o_orderkey as string), 8, '0')) as id,
    concat('home-', lpad(cast(o_custkey as string), 6, '0')) as home_id,
    concat(cast(100 + o_custkey as string), ' Oak Street') as street,
    concat(cast(100 + o_custkey as string), ' Oak Street, Naperville, IL 60540') as address,
    replace(c_name, '#', ' ') as owner_name,
    s.status, s.scenario_type,
    case (o_orderkey * 31) % 97 % 5 when 0 then 'UPS' when 1 then 'FedEx' when 2 then 'USPS'
      when 3 then 'Amazon' else 'DHL' end as carrier,
    s.delivery_location,
    cast(s.lo + o_orderkey % (s.hi - s.lo + 1) as double) / 100 as risk_score,
    s.factors_csv, s.alert_type,
    o_orderdate + (o_orderkey % 86400) * interval '1' second as created_ts,
    case when (o_orderkey * 17) % 89 < 9 then 'processed' else 'pending' end as processing_status,
    o_orderkey, o_orderkey % {vector_numbers} as vec_id
  from pick p join scen s on p.scen = s.scenario_type
), tmpl as (
  select * from (values {tmpl}) as t(scenario_type, ord, event_type, location, offset_sec)
), raw_events as (
  select concat(d.id, '-', cast(t.ord as string)) as event_id, d.id as delivery_id, d.home_id, t.ord,
    t.event_type, t.location, d.created_ts + t.offset_sec * interval '1' second as event_ts,
    d.o_orderkey * 7 + t.ord as n
  from raw_deliveries d join tmpl t on d.scenario_type = t.scenario_type
), homes as (
  select concat('home-', lpad(cast(c_custkey as string), 6, '0')) as id,
    concat(cast(100 + c_custkey as string), ' Oak Street') as address,
    'Naperville' as city, 'IL' as state, '60540' as zip_code,
    replace(c_name, '#', ' ') as owner_name,
    lpad(cast(c_custkey as string), 6, '0') as tail,
    c_custkey % 10 < 7 as has_lock,
    case when c_custkey % 4 = 0 then 'basic' else 'premium' end as subscription_tier,
    case c_custkey % 5 when 0 then '3.2.1' when 1 then '3.2.0' when 2 then '3.1.4' when 3 then '3.1.3'
      else '3.0.9' end as firmware,
    41.7 + cast(c_custkey * 37 % 350 as double) / 1000 as latitude,
    -88.3 + cast(c_custkey * 53 % 500 as double) / 1000 as longitude
  from {customer}
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """A table of a few small files would keep most cores idle; a large one has splits enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.isStreaming or df.rdd.getNumPartitions() < cores
    return df.repartition(cores, key) if few else df


def _run(spark: SparkSession, sf_dir: str, select: str, orders: DataFrame | None = None) -> DataFrame:
    orders = _spread(table(spark, sf_dir, "orders") if orders is None else orders, "o_orderkey")
    vectors = table(spark, sf_dir, "embeddings").count()
    return spark.sql(fixture_sql("{orders}", "{customer}", str(vectors + vectors // 20 + 1)) + select,
                     orders=orders, customer=table(spark, sf_dir, "customer"))


def delivery_rows(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    return _run(spark, sf_dir, "select * from raw_deliveries", orders)


def _steps():
    """Constant map from scenario to its event steps; folded by the optimizer."""
    steps = lambda events: ", ".join(
        f"named_struct('type', '{t}', 'place', '{place}', 'sec', {sec})" for t, place, sec in events)
    return F.expr("map(" + ", ".join(f"'{s}', array({steps(e)})" for s, e in TEMPLATE.items()) + ")")


def deliveries(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, ids: DataFrame | None = None,
               timed: bool = True) -> DataFrame:
    """Raw deliveries as documents, timeline included; keeps vec_id and street for later joins.

    With `ids`, a table of one column, only rows with one of these ids are made into documents.
    With `timed` off the same rows come with the type and place of each event only, for `ready_vectors`, which reads nothing
    made from ids, texts and times of events: they cost more than all the rest.
    """
    rows = delivery_rows(spark, sf_dir, orders)
    if ids is not None:
        rows = rows.join(ids, "id", "left_semi")
    created = F.col("created_ts")
    entry = lambda s, i: F.struct(
        F.concat(F.col("id"), F.lit("-"), i.cast("string")).alias("event_id"),
        s["type"].alias("event_type"),
        s["place"].alias("location"),
        episode.event_summary(s["type"], s["place"]).alias("summary"),
        iso_text(created + F.make_dt_interval(secs=s["sec"])).alias("timestamp"))
    none = F.lit(None).cast("string")
    bare = lambda s: F.struct(none.alias("event_id"), s["type"].alias("event_type"), s["place"].alias("location"),
                              none.alias("summary"), none.alias("timestamp"))
    timeline = F.transform(F.try_element_at(_steps(), F.col("scenario_type")), entry if timed else bare)
    # a generator of one element: filters on the timeline do not pull its computation below the join
    rows = rows.select("*", F.explode(F.array(timeline)).alias("event_timeline"))
    return rows.select(
        "id", "home_id", "address", "owner_name", "status", "scenario_type", "carrier",
        iso_text(created - F.expr("interval 4 hours")).alias("expected_window_start"),
        iso_text(created - F.expr("interval 1 hour")).alias("expected_window_end"),
        episode.actual_delivery_time(F.col("status"), F.col("event_timeline"))
               .alias("actual_delivery_time"),
        "delivery_location",
        F.transform("event_timeline", lambda e: e["event_id"]).alias("event_ids"),
        "event_timeline", "risk_score",
        F.filter(F.split("factors_csv", ","), lambda x: x != "").alias("risk_factors"),
        iso_text(created).alias("created_at"),
        iso_text(created).alias("updated_at"),
        "processing_status", "vec_id", "street",
    )


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, "select * from homes")
    fixed = [("GDO-SEN-", "garage_door_sensor", "garage"), ("CAM-GAR-", "garage_camera", "garage"),
             ("CAM-FRT-", "front_door_camera", "front_door"), ("LCK-FRT-", "front_door_lock", "front_door")]
    devices = F.array(*[
        F.struct(F.concat(F.lit(prefix), F.col("tail")).alias("device_id"), F.lit(kind).alias("type"),
                 F.lit(place).alias("location"), F.col("firmware").alias("firmware"))
        for prefix, kind, place in fixed])
    return rows.select(
        "id", "address", "city", "state", "zip_code", "owner_name",
        F.when(F.col("has_lock"), devices).otherwise(F.slice(devices, 1, 3)).alias("devices"),
        "subscription_tier", F.lit(True).alias("has_garage_camera"),
        F.lit(True).alias("has_front_door_camera"), F.lit(1).alias("num_garage_doors"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor events: one row each, with readings derived from the event number."""
    rows = _run(spark, sf_dir, "select * from raw_events")
    kind, n = F.col("event_type"), F.col("n")
    seen = kind.isin("camera_motion", "person_detected", "unknown_person")
    label = (F.when(kind == "person_detected", "delivery_driver").when(kind == "camera_motion", "person")
             .when((kind == "package_detected") & (F.col("location") == "behind_vehicle"),
                   "package_near_vehicle")
             .when(kind == "package_detected", "package").when(kind == "unknown_person", "unknown_person"))
    readings = F.struct(
        F.when(kind == "door_open", 90 + (n % 50) / 10).when(kind == "door_close", F.lit(0.0))
         .when(kind == "door_stuck", 85 + (n % 100) / 10).alias("door_angle"),
        F.when(seen, 0.75 + (n % 25) / 100).alias("motion_confidence"),
        label.alias("classification_label"),
        F.when(label.isNotNull(), 0.85 + (n % 7) / 100).alias("classification_confidence"),
        (-30 - n % 40).cast("double").alias("signal_strength"),
        F.lit("3.2.1").alias("firmware_version"),
    )
    return rows.select(
        F.col("event_id").alias("id"), kind.alias("type"), "home_id", F.lit(None).cast("string").alias("device_id"),
        iso_text(F.col("event_ts")).alias("timestamp"), "location", readings.alias("raw_data"),
        "delivery_id", iso_text(F.col("event_ts")).cast("timestamp").alias("event_ts"),
    )


def processed(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None, timed: bool = True) -> DataFrame:
    """Enriched deliveries with a fixed processing time, so that runs compare equal."""
    return enrich(deliveries(spark, sf_dir, ids=ids, timed=timed), processed_at=F.lit("2024-01-01T00:00:00.000Z"))


def _with_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.join(vectors, "vec_id", "left").withColumn("is_ai_ready", F.col("embedding").isNotNull())


def ai_ready(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Enriched deliveries with their vector from the embeddings table; all of them, or those with one of `ids`."""
    return _with_vectors(spark, sf_dir, processed(spark, sf_dir, ids))


def ready_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `ai_ready` with what a search index holds of them."""
    return index_rows(_with_vectors(spark, sf_dir, processed(spark, sf_dir, timed=False)))
