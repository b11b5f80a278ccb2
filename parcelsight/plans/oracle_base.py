"""Oracle side of the fixtures: the common CTEs, in SQL that DuckDB runs."""

from parcelsight.plans.fixtures import fixture_sql

ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def level_sql(c: str) -> str:
    return (f"case when {c} >= 0.75 then 'critical' when {c} >= 0.45 then 'high' "
            f"when {c} >= 0.2 then 'medium' else 'low' end")


def percent_sql(c: str) -> str:
    return f"printf('%.0f%%', {c} * 100)"


def spaced_sql(c: str) -> str:
    return f"replace({c}, '_', ' ')"


def title_sql(c: str) -> str:
    words = f"string_split({spaced_sql(c)}, ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || w[2:]), ' ')"


NAME_SQL = """case scenario_type when 'no_package_placed' then 'Missing Package'
    when 'theft_suspicious' then 'Suspicious Activity' else """ + title_sql("scenario_type") + " end"

SHORT_SQL = """case scenario_type
  when 'happy_path' then carrier || ' package safely delivered inside your garage. Door confirmed closed and secured — no action needed.'
  when 'front_door_misdelivery' then carrier || ' left your package at the front door instead of the garage — exposed to weather and theft. Retrieve it soon.'
  when 'package_behind_car' then carrier || ' placed your package behind your car in the garage — it could be crushed when you back out. Move it before driving.'
  when 'door_stuck_open' then 'Garage door stuck open after ' || carrier || ' delivery — package is inside but garage is unsecured. Immediate action required.'
  when 'no_package_placed' then 'Garage door opened for ' || carrier || ' but no package detected inside — possible missed delivery or wrong drop-off.'
  when 'delivery_timeout' then 'Expected ' || carrier || ' delivery never arrived — delivery window expired with no carrier activity.'
  when 'theft_suspicious' then 'Unknown person detected near your ' || carrier || ' package at the front door shortly after delivery. Check your camera immediately.'
  end"""

ADVICE_SQL = """case f
  when 'door_stuck_open' then 'Dispatch technician to check garage door mechanism'
  when 'garage_accessible' then 'Dispatch technician to check garage door mechanism'
  when 'package_wrong_location' then 'Notify homeowner of misdelivered package location'
  when 'not_in_garage' then 'Notify homeowner of misdelivered package location'
  when 'package_behind_vehicle' then 'Send urgent alert to move package before driving'
  when 'crush_risk' then 'Send urgent alert to move package before driving'
  when 'package_theft_risk' then 'Alert homeowner and review security camera footage'
  when 'suspicious_activity_after_delivery' then 'Alert homeowner and review security camera footage'
  when 'delivery_not_received' then 'Contact carrier for delivery status update'
  when 'window_expired' then 'Contact carrier for delivery status update' end"""

# deliveries with their timeline, and the processed form of the pending ones
BASE = fixture_sql() + f"""
, ev as (
  select e.*, strftime(event_ts, {ISO}) as ts, case event_type
    when 'delivery_window_start' then 'Delivery window opened'
    when 'delivery_window_end' then 'Delivery window expired'
    when 'person_detected' then 'Person detected at ' || location
    when 'door_open' then 'Garage door opened'
    when 'door_close' then 'Garage door closed'
    when 'door_stuck' then 'Garage door stuck open - alert triggered'
    when 'camera_motion' then 'Motion detected at ' || location
    when 'package_detected' then 'Package detected at ' || location
    when 'package_not_detected' then 'No package detected after door opened'
    when 'delivery_confirmed' then 'Delivery confirmed successfully'
    when 'delivery_timeout' then 'Delivery timed out - no activity detected'
    when 'unknown_person' then 'Unknown person detected near package' end as summary
  from raw_events e
), tl as (
  select delivery_id, count(*) as n_events, max(ts) as last_ts,
    string_agg(event_id, ',' order by ord) as event_ids,
    string_agg(concat_ws('|', event_id, event_type, location, summary, ts), ';' order by ord) as timeline,
    string_agg('  ' || (ord + 1) || '. ' || summary || ' at ' || location || ' (' || event_type || ')',
               ' ' order by ord) as story
  from ev group by delivery_id
), advice as (
  select scenario_type, factors_csv, case when factors_csv = '' then [] else string_split(factors_csv, ',') end as factors,
    list_filter(list_transform(string_split(factors_csv, ','), lambda f: {ADVICE_SQL}), lambda a: a is not null) as recs
  from scen
), dl as (
  select d.*, tl.n_events, tl.last_ts, tl.event_ids, tl.timeline, tl.story, a.factors, a.recs,
    strftime(created_ts, {ISO}) as created_at, {level_sql('risk_score')} as level
  from raw_deliveries d join tl on d.id = tl.delivery_id join advice a on d.scenario_type = a.scenario_type
), told as (
  select dl.* replace (array_to_string(list_transform(string_split(owner_name, ' '),
                         lambda w: upper(w[1]) || '***'), ' ') as owner_name),
    dl.owner_name as raw_name
  from dl where processing_status = 'pending'
), pr as (
  select told.*, 'Delivery ' || id || ' for ' || owner_name || ' at ' || address || '. Carrier: ' || carrier
    || '. Scenario: ' || {spaced_sql('scenario_type')} || '. Event sequence: ' || story
    || ' Final status: ' || {spaced_sql('status')} || '. Package location: '
    || {spaced_sql('delivery_location')} || '.'
    || case when risk_score > 0 then printf(' Risk score: %.1f%%.', risk_score * 100) else '' end
    || case when factors_csv <> '' then ' Risk factors: '
         || {spaced_sql("replace(factors_csv, ',', ', ')")} || '.' else '' end as knowledge_summary
  from told
), px as (
  select pr.*, knowledge_summary || ' Delivery scenario: ' || {spaced_sql('scenario_type')}
    || '. Delivery status: ' || {spaced_sql('status')} || '. Location: ' || address
    || '. Risk level: ' || level || '.' as embedding_text
  from pr
), al as (
  select replace(id, 'del-', 'alert-') as id, id as delivery_id, home_id, address, alert_type,
    case alert_type when 'theft_risk' then 'critical' when 'door_stuck' then 'high'
      when 'package_at_risk' then 'high' when 'delivery_timeout' then 'low' else 'medium' end as severity,
    case alert_type
      when 'misdelivery' then 'Package delivered to front door instead of garage at ' || street
      when 'package_at_risk' then 'Package placed behind vehicle in garage at ' || street || ' - crush risk'
      when 'door_stuck' then 'Garage door stuck open at ' || street || ' - security risk'
      when 'no_package' then 'Garage door opened but no package detected at ' || street
      when 'delivery_timeout' then 'Expected delivery not received at ' || street || ' - window expired'
      else 'Suspicious activity detected near package at ' || street || ' - possible theft' end as message,
    created_at as triggered_at, event_ids
  from dl where alert_type <> ''
)
"""

# processed deliveries with vectors; every search below ranks by (distance, id)
VECTORS = BASE + """
, ready as (
  select px.*, e.embedding::double[] as vec from px join embeddings e on px.vec_id = e.vec_id
)
"""
