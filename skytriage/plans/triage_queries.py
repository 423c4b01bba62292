"""Triage rules over joins (J)."""

import datetime as dt

from pyspark.sql import functions as F

from skytriage.operators import actions as ac, triage as tr
from skytriage.operators.features import track_summary
from skytriage.plans.fixtures import ctes, table, view
from skytriage.plans.registry import query


def _py(expr: str, digits: int) -> str:
    """Rounding of the exact binary value on the checking side."""
    return f"CAST(printf('%.{digits}f', {expr}) AS DOUBLE)"


# --- J1, J2 ---------------------------------------------------------------------
_TRACKS = """
    SELECT CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS track_id,
           l_orderkey % 90 AS n_observations, l_extendedprice / 10000.0 AS duration_seconds, l_extendedprice / 2500.0 AS median_pixels_on_target,
           CASE WHEN l_linenumber < 7 THEN l_extendedprice / 7000.0 END AS mean_speed, CASE WHEN l_linenumber < 7 THEN l_tax * l_extendedprice / 300 END AS speed_variance,
           CASE WHEN l_linenumber < 7 THEN l_discount * l_quantity / 3 END AS acceleration_variance, CASE WHEN l_linenumber < 7 THEN l_quantity / 7 END AS vertical_oscillation_hz,
           CASE WHEN l_linenumber < 7 THEN l_discount * 9.9995 END AS vertical_oscillation_power, CASE WHEN l_linenumber < 7 THEN l_tax * 12.3456 END AS heading_entropy,
           CASE WHEN l_linenumber < 7 THEN l_quantity / 50 END AS hover_fraction, CASE WHEN l_linenumber < 7 THEN 1 + l_discount END AS trajectory_smoothness,
           CASE WHEN l_linenumber < 7 THEN l_tax / 7 END AS scale_change_rate,
           l_partkey % 3 > 0 AS classifier_trained, CASE l_partkey % 4 WHEN 0 THEN 'bird' WHEN 1 THEN 'aircraft' ELSE 'drone' END AS classifier_label,
           l_quantity / 51 AS classifier_confidence, l_quantity / 51 - l_discount * 2 AS interval_low, l_quantity / 51 + l_tax * 2 AS interval_high
    FROM {lineitem}"""
_MEASURES = [(n, d) for n, d in tr._DECIMALS.items()]


@query("j1_j2_analyze_tracks", f"""WITH t AS ({_TRACKS.format(lineitem='lineitem')})
  SELECT track_id, n_observations, {_py('duration_seconds', 2)} AS duration_seconds, {_py('median_pixels_on_target', 1)} AS median_pixels_on_target,
         median_pixels_on_target >= 20 AS appearance_reliable, mean_speed IS NOT NULL AS features_available,
         {', '.join(f'{_py(n, d)} AS {n}' for n, d in _MEASURES)}, {_py('hover_fraction * duration_seconds', 2)} AS hover_seconds,
         CASE WHEN NOT classifier_trained THEN 'no_classifier_trained' WHEN interval_high - interval_low > 0.30 THEN 'undetermined' ELSE 'determined' END AS classifier_status,
         CASE WHEN classifier_trained THEN classifier_label END AS classifier_label, CASE WHEN classifier_trained THEN {_py('classifier_confidence', 3)} END AS classifier_confidence,
         CASE WHEN classifier_trained THEN {_py('interval_low', 3)} END AS interval_low, CASE WHEN classifier_trained THEN {_py('interval_high', 3)} END AS interval_high
  FROM t""")
def analyzed(spark, sf):
    return tr.analyze_tracks(spark.sql(_TRACKS, lineitem=table(spark, sf, "lineitem")))


# --- J3, J4 ---------------------------------------------------------------------
def _sites(spark, sf):
    return table(spark, sf, "customer").where("c_custkey < 45").select(
        F.col("c_custkey").alias("site_id"),
        F.when(F.col("c_custkey") % 3 == 0, "restricted").when(F.col("c_custkey") % 3 == 1, "controlled").otherwise("open").alias("zone_class"))


@query("j3_match_authorization", ctes("fx_authorized_flights", "fx_sightings") + """,
    hit AS (SELECT s.site_id, s.observed_at, min(f.flight_id) AS flight_id
            FROM (SELECT DISTINCT site_id, observed_at FROM fx_sightings) s JOIN fx_authorized_flights f
              ON f.site_id = s.site_id AND s.observed_at BETWEEN f.starts_at AND f.ends_at GROUP BY 1, 2)
  SELECT s.source_video, s.frame_index, s.site_id, s.observed_at, s.site_id < 45 AS site_known,
         s.site_id < 45 AND h.flight_id IS NOT NULL AS authorized, CASE WHEN s.site_id < 45 THEN h.flight_id END AS flight_id
  FROM fx_sightings s LEFT JOIN hit h USING (site_id, observed_at)""")
def authorized(spark, sf):
    flights = view(spark, sf, "fx_authorized_flights").withColumns({"ordinal": F.col("flight_id"), "operator": F.lit("op")})
    return tr.match_authorization(view(spark, sf, "fx_sightings"), flights, _sites(spark, sf)).drop("operator", "match_basis")


@query("j4_zone_status", ctes("fx_sightings") + """,
    r AS (SELECT o_custkey % 50 AS site_id, o_orderdate AS starts_at, o_orderdate + INTERVAL '90' MINUTE AS ends_at, o_orderkey AS ordinal,
                 o_orderstatus AS reason FROM orders WHERE o_orderpriority = '1-URGENT'),
    hit AS (SELECT s.site_id, s.observed_at, arg_min(r.reason, r.ordinal) AS reason
            FROM (SELECT DISTINCT site_id, observed_at FROM fx_sightings) s JOIN r ON r.site_id = s.site_id AND s.observed_at BETWEEN r.starts_at AND r.ends_at GROUP BY 1, 2)
  SELECT s.*, s.site_id < 45 AS site_known, CASE WHEN s.site_id < 45 THEN CASE s.site_id % 3 WHEN 0 THEN 'restricted' WHEN 1 THEN 'controlled' ELSE 'open' END END AS zone_class,
         s.site_id < 45 AND h.reason IS NOT NULL AS restriction_active, CASE WHEN s.site_id < 45 THEN h.reason END AS restriction_reason
  FROM fx_sightings s LEFT JOIN hit h USING (site_id, observed_at)""")
def zones(spark, sf):
    r = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        (F.col("o_custkey") % 50).alias("site_id"), F.col("o_orderdate").alias("starts_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL '90' MINUTE")).alias("ends_at"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("reason"))
    return tr.zone_status(view(spark, sf, "fx_sightings"), _sites(spark, sf), r)


# --- J5, J6, J7 -----------------------------------------------------------------
@query("j5_query_history", f"""
  WITH h AS (SELECT user_id % 5 AS site_id, event_id, ts, value FROM events WHERE ts > TIMESTAMP '2024-03-01 12:00:00' - INTERVAL '31' DAY),
  t AS (SELECT o_orderkey AS asked, CASE WHEN o_orderkey % 11 <> 3 THEN o_custkey % 6 END AS site_id, CASE WHEN o_orderkey % 13 <> 4 THEN o_totalprice / 5000.0 END AS px FROM orders),
  m AS (SELECT t.asked, h.event_id FROM t JOIN h ON h.site_id = t.site_id AND h.value BETWEEN t.px - 8 AND t.px + 8),
  g AS (SELECT asked, count(*) AS n, list_slice(list_sort(list(event_id)), 1, 10) AS firsts FROM m GROUP BY asked)
  SELECT t.asked, t.site_id, coalesce(g.n, 0) AS match_count, coalesce(array_to_string(g.firsts, ','), '') AS firsts, coalesce(g.n, 0) > 10 AS truncated,
         {_py('t.px - 8', 1)} AS band_low_px, {_py('t.px + 8', 1)} AS band_high_px FROM t LEFT JOIN g USING (asked)""")
def history(spark, sf):
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("site_id"), F.col("event_id").alias("ordinal"), F.col("event_id").cast("string").alias("track_id"),
        F.col("ts").alias("observed_at"), F.col("value").alias("median_pixels_on_target"), F.col("event_type").alias("verdict"))
    # Some tracks have no site, some no size.
    asked = F.col("o_orderkey")
    t = table(spark, sf, "orders").select(asked.alias("asked"), F.when(asked % 11 != 3, F.col("o_custkey") % 6).alias("site_id"),
                                          F.when(asked % 13 != 4, F.col("o_totalprice") / 5000.0).alias("median_pixels_on_target"))
    out = tr.query_history(t, e, dt.datetime(2024, 3, 1, 12, tzinfo=dt.timezone.utc))
    return out.select("asked", "site_id", "match_count", F.array_join(F.col("matches.track_id"), ",").alias("firsts"), "truncated", "band_low_px", "band_high_px")


@query("j6_evidence_bounds", ctes("fx_observations") + f""",
    t AS (SELECT track_id, min(frame_index) AS a, max(frame_index) AS b FROM fx_observations GROUP BY 1),
    c AS (SELECT 't' || CAST(doc_id AS VARCHAR) AS track_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 = 0)
  SELECT track_id, {_py('greatest(0, a / 30.0 - 3)', 2)} AS start_seconds, {_py('b / 30.0 + 3', 2)} AS end_seconds, sha256, sha256 IS NOT NULL AS clip_exists
  FROM t LEFT JOIN c USING (track_id)""")
def bounds(spark, sf):
    t = track_summary(view(spark, sf, "fx_observations"), 30.0).withColumn("fps", F.lit(30.0))
    clips = table(spark, sf, "documents").where("doc_id % 3 = 0").select(
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("track_id"), F.encode("text", "utf-8").alias("content"))
    return tr.evidence_bounds(t, clips)


_TOOLS = ["analyze_track", "check_authorization", "check_airspace_zone", "query_history", "get_evidence_clip"]
_CALLS = """SELECT event_id % 3001 AS track_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'analyze_track' WHEN 1 THEN 'check_authorization'
    WHEN 2 THEN 'check_airspace_zone' WHEN 3 THEN 'query_history' ELSE 'get_evidence_clip' END AS tool_name, value > 6 AS ok,
    CASE WHEN value > 6 THEN props END AS result FROM {events}"""


@query("j7_assemble_evidence", f"""WITH c AS ({_CALLS.format(events='events')}),
    p AS (SELECT track_id, tool_name, max_by(result, seq) FILTER (ok) AS result, bool_or(ok) AS worked, min(seq) FILTER (NOT ok) AS failed_at FROM c GROUP BY 1, 2)
  SELECT track_id, coalesce(string_agg(tool_name, ',' ORDER BY failed_at) FILTER (NOT worked), '') AS failed_tools,
         {', '.join(f"max(result) FILTER (tool_name = '{t}' AND worked) AS {t}" for t in _TOOLS)} FROM p GROUP BY track_id""")
def assembled(spark, sf):
    out = tr.assemble_evidence(spark.sql(_CALLS, events=table(spark, sf, "events")))
    return out.withColumn("failed_tools", F.array_join("failed_tools", ","))


# --- J8, J9, J10, J18 -----------------------------------------------------------
_EVIDENCE = """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 37 = 0 THEN {one} ELSE {none} END AS failed_tools,
           l_partkey % 41 = 0 AS round_cap_reached, l_partkey % 43 <> 0 AS has_analysis, l_quantity / 5.0 AS duration_seconds,
           CAST(l_orderkey % 400 AS DOUBLE) / 10 AS median_pixels_on_target, l_linenumber <> 7 AS features_available,
           CAST(l_orderkey % 120 AS DOUBLE) / 10 AS vertical_oscillation_hz, CAST(l_partkey % 100 AS DOUBLE) / 100 AS vertical_oscillation_power,
           CAST(l_suppkey % 60 AS DOUBLE) / 10 AS hover_seconds,
           CASE l_orderkey % 5 WHEN 0 THEN 'no_classifier_trained' WHEN 1 THEN 'undetermined' ELSE 'determined' END AS classifier_status,
           CASE l_partkey % 4 WHEN 0 THEN 'bird' WHEN 1 THEN 'aircraft' WHEN 2 THEN 'drone' ELSE 'unknown' END AS classifier_label,
           CAST(l_orderkey % 100 AS DOUBLE) / 100 AS classifier_confidence, CAST(l_orderkey % 80 AS DOUBLE) / 100 AS interval_low,
           CAST(l_orderkey % 80 + 20 AS DOUBLE) / 100 AS interval_high, l_partkey % 9 = 0 AS authorized, l_orderkey AS flight_id, 'op' AS operator,
           CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey % 6 > 1 END AS site_known,
           CASE WHEN l_suppkey % 6 > 1 THEN CASE l_suppkey % 3 WHEN 0 THEN 'restricted' WHEN 1 THEN 'controlled' ELSE 'open' END END AS zone_class,
           l_suppkey % 6 > 1 AND l_suppkey % 10 = 3 AS restriction_active, 'event' AS restriction_reason,
           CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber - 2 AS BIGINT) END AS history_count, 30 AS history_days
    FROM {lineitem}"""


def evidence(spark, sf):
    text = _EVIDENCE.replace("{one}", "array('query_history')").replace("{none}", "array()")
    return spark.sql(text, lineitem=table(spark, sf, "lineitem"))


_DECIDED = f"""WITH ev AS ({_EVIDENCE.format(one="['query_history']", none="CAST([] AS VARCHAR[])", lineitem="lineitem")}),
    ruled AS (SELECT *, CASE WHEN len(failed_tools) > 0 THEN 'uncertain.tool_failure' WHEN round_cap_reached THEN 'uncertain.round_cap'
      WHEN NOT has_analysis THEN 'uncertain.no_analysis' WHEN authorized THEN 'dismiss.authorized_flight'
      WHEN NOT features_available THEN 'watch.track_too_short' WHEN duration_seconds < 2 THEN 'watch.track_too_brief'
      WHEN hover_seconds >= 3 AND vertical_oscillation_power < 0.35 THEN 'escalate.sustained_hover'
      WHEN vertical_oscillation_hz BETWEEN 2 AND 8 AND vertical_oscillation_power >= 0.35 THEN 'dismiss.flapping_band'
      WHEN classifier_status = 'no_classifier_trained' THEN 'uncertain.no_classifier' WHEN classifier_status = 'undetermined' THEN 'uncertain.classifier_undetermined'
      WHEN classifier_label IN ('bird', 'aircraft') AND classifier_confidence < 0.75 THEN 'uncertain.classifier_low_confidence'
      WHEN classifier_label IN ('bird', 'aircraft') THEN 'dismiss.classifier_non_drone' ELSE 'escalate.unexplained' END AS rule_id FROM ev),
    decided AS (SELECT *, CASE WHEN rule_id LIKE 'dismiss%' THEN 'dismiss' WHEN rule_id LIKE 'watch%' THEN 'watch' ELSE 'escalate' END AS verdict,
      CASE rule_id WHEN 'uncertain.tool_failure' THEN 'tool_failure' WHEN 'uncertain.round_cap' THEN 'round_cap_reached' WHEN 'uncertain.no_analysis' THEN 'tool_failure'
        WHEN 'watch.track_too_short' THEN 'track_too_short' WHEN 'watch.track_too_brief' THEN 'track_too_short' WHEN 'uncertain.no_classifier' THEN 'no_classifier_trained'
        WHEN 'uncertain.classifier_undetermined' THEN 'classifier_undetermined' WHEN 'uncertain.classifier_low_confidence' THEN 'classifier_low_confidence' ELSE 'none' END AS uncertainty,
      CASE WHEN rule_id LIKE 'dismiss%' OR rule_id LIKE 'watch%' THEN 'routine'
           WHEN rule_id LIKE 'escalate%' AND (coalesce(restriction_active, FALSE) OR coalesce(zone_class = 'restricted', FALSE)) THEN 'immediate' ELSE 'prompt' END AS attention FROM ruled)"""
_ID = "l_orderkey, l_linenumber, l_partkey"


@query("j8_j9_decide", f"{_DECIDED} SELECT {_ID}, rule_id, verdict, uncertainty, attention FROM decided")
def decided(spark, sf):
    return tr.decide(evidence(spark, sf)).select(*_ID.split(", "), "rule_id", "verdict", "uncertainty", "attention")


@query("j10_rationale", f"""{_DECIDED}, r AS (SELECT *, printf('%.1f px over %.1f s', median_pixels_on_target, duration_seconds) AS m,
      printf('vertical oscillation %.1f Hz, power share %.2f', vertical_oscillation_hz, vertical_oscillation_power) AS flap, printf('hover %.1f s', hover_seconds) AS hov,
      printf('classifier: %s at %.2f', classifier_label, classifier_confidence) AS says,
      'interval [' || CAST(interval_low AS VARCHAR) || ', ' || CAST(interval_high AS VARCHAR) || ']' AS iv,
      CASE WHEN site_known IS NULL THEN [] WHEN NOT site_known THEN ['site not in registry']
           ELSE ['airspace: ' || zone_class] || CASE WHEN restriction_active THEN ['restriction active: event'] ELSE [] END END AS z,
      CASE WHEN median_pixels_on_target > 0 AND median_pixels_on_target < 20 THEN [printf('%.0f px is below 20 px: motion only, appearance unreliable', median_pixels_on_target)] ELSE [] END AS c,
      CASE WHEN history_count IS NULL THEN [] WHEN history_count = 0 THEN ['no similar track at this site in the window']
           ELSE [printf('%d similar tracks at this site in 30 days', history_count)] END AS h FROM decided)
  SELECT {_ID}, array_to_string(CASE rule_id WHEN 'uncertain.tool_failure' THEN ['failed tools: query_history'] WHEN 'uncertain.round_cap' THEN ['round cap reached']
      WHEN 'uncertain.no_analysis' THEN ['no track analysis'] WHEN 'dismiss.authorized_flight' THEN [m, 'authorized flight ' || flight_id || ' (op)', 'matched by site and time only']
      WHEN 'watch.track_too_short' THEN [m, 'no motion features'] WHEN 'watch.track_too_brief' THEN [m, printf('%.1f s is below 2 s', duration_seconds)]
      WHEN 'escalate.sustained_hover' THEN [m, hov, flap] || z || c WHEN 'dismiss.flapping_band' THEN [m, flap, hov, 'flapping band is assumed, not fitted']
      WHEN 'uncertain.no_classifier' THEN [m, 'no trained classifier'] || z || c WHEN 'uncertain.classifier_undetermined' THEN [m, iv || ' too wide'] || z || c
      WHEN 'uncertain.classifier_low_confidence' THEN [m, says || ', below 0.75'] || z || c WHEN 'dismiss.classifier_non_drone' THEN [m, says || ', ' || iv]
      ELSE [m, 'nothing explains this track'] || z || c || h END, ' | ') AS rationale FROM r""")
def rationale(spark, sf):
    return tr.decide(evidence(spark, sf)).select(*_ID.split(", "), F.array_join("rationale", " | ").alias("rationale"))


@query("j18_verdict_tallies", f"""{_DECIDED} SELECT rule_id, count(*) FILTER (verdict = 'dismiss') AS dismiss, count(*) FILTER (verdict = 'watch') AS watch,
  count(*) FILTER (verdict = 'escalate') AS escalate, count(*) FILTER (verdict = 'escalate' AND uncertainty <> 'none') AS uncertain_escalations FROM decided GROUP BY rule_id""")
def tallies(spark, sf):
    return tr.verdict_tallies(tr.decide(evidence(spark, sf)))


# --- J11-J17, J19-J22 -----------------------------------------------------------
@query("j11_audit_hash", """SELECT o_orderkey, sha256('{"n":' || o_custkey || ',"tool_calls":[{"ok":' || CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"tool_name":"analyze_track"}],"track_id":"t' || o_orderkey || '","verdict":' || CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE '"watch"' END || '}') AS audit_hash FROM orders""")
def audit(spark, sf):
    o = table(spark, sf, "orders")
    call = F.struct(F.lit("analyze_track").alias("tool_name"), (F.col("o_custkey") % 2 == 0).alias("ok"), F.col("o_totalprice").alias("duration_ms"))
    d = o.select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("track_id"), F.when(F.col("o_custkey") % 3 != 0, "watch").alias("verdict"),
                 F.col("o_custkey").alias("n"), F.array(call).alias("tool_calls"), F.col("o_orderdate").alias("created_at"))
    return ac.with_audit_hash(d).select(F.substring("track_id", 2, 20).cast("long").alias("o_orderkey"), "audit_hash")


_DEC = "SELECT o_custkey AS track_id, o_orderdate AS created_at, o_orderkey AS decision_id, o_orderpriority AS verdict FROM {orders}"


@query("j12_first_decision", f"""WITH d AS ({_DEC.format(orders='orders')})
  SELECT track_id, created_at, decision_id, verdict FROM d QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY created_at, decision_id) = 1""")
def first_decision(spark, sf):
    return tr.first_decisions(spark.sql(_DEC, orders=table(spark, sf, "orders")))


@query("j13_route_notifications", """WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS track_id, CASE o_orderkey % 3 WHEN 0 THEN 'dismiss' WHEN 1 THEN 'watch' ELSE 'escalate' END AS verdict FROM orders),
    r AS (SELECT *, CASE WHEN verdict = 'dismiss' THEN 'local-dismiss-' ELSE 'local-' END || track_id AS ref FROM d)
  SELECT track_id, verdict, ref, CASE WHEN verdict = 'dismiss' THEN '#airspace-audit' ELSE '#airspace-alerts' END AS channel,
         ref IN (SELECT 'local-' || CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 1) AS updated FROM r""")
def routed(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(k.cast("string").alias("track_id"), F.when(k % 3 == 0, "dismiss").when(k % 3 == 1, "watch").otherwise("escalate").alias("verdict"))
    posted = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("local-"), F.col("l_orderkey").cast("string")).alias("ref"))
    return ac.route_notifications(d, posted)


@query("j14_action_budget", """SELECT user_id % 5 AS site_id, user_id AS run_id, event_id AS seq,
  CASE WHEN row_number() OVER w <= 4 THEN 'allowed' WHEN row_number() OVER w = 5 THEN 'budget_exhausted' ELSE 'circuit_open' END AS outcome
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def budget(spark, sf):
    return ac.apply_budget(table(spark, sf, "events").select((F.col("user_id") % 5).alias("site_id"), F.col("user_id").alias("run_id"), F.col("event_id").alias("seq")))


@query("j15_open_incidents", """SELECT substr(sha256('incident:' || CAST(user_id AS VARCHAR)), 1, 32) AS incident_id, CAST(user_id AS VARCHAR) AS track_id,
  arg_min(event_type, event_id) AS summary, count(*) AS n_requests FROM events GROUP BY user_id""")
def incidents(spark, sf):
    return ac.open_incidents(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("track_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("summary")))


_PRESS = """SELECT event_id, ts AS received_at, CASE event_id % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'dismiss_as_bird' WHEN 2 THEN 'mark_authorized' WHEN 3 THEN 'other' ELSE 'confirm' END AS action_id,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS track_id, event_type AS who FROM {events}"""


def _presses(spark, sf):
    p = spark.sql(_PRESS, events=table(spark, sf, "events"))
    action = F.struct("action_id", F.col("track_id").alias("value"))
    return p.select("received_at", F.to_json(F.struct(F.array(action).alias("actions"), F.struct(F.col("who").alias("name"), F.concat(F.lit("U"), F.col("who")).alias("id")).alias("user"))).alias("payload"))


@query("j16_ingest_feedback", f"""WITH p AS ({_PRESS.format(events='events')}), d AS (SELECT CAST(c_custkey AS VARCHAR) AS track_id, c_custkey AS decision_id FROM customer WHERE c_custkey % 4 <> 0),
    j AS (SELECT p.*, d.decision_id, CASE WHEN action_id = 'other' THEN 'unrecognised action' WHEN p.track_id = '' THEN 'no track id' END AS refusal FROM p LEFT JOIN d USING (track_id))
  SELECT CASE WHEN refusal IS NOT NULL THEN refusal WHEN decision_id IS NULL THEN 'unmatched' ELSE 'stored' END AS state,
         CASE WHEN refusal IS NULL AND decision_id IS NOT NULL THEN CASE action_id WHEN 'confirm' THEN 'confirmed' WHEN 'dismiss_as_bird' THEN 'dismissed_as_bird' ELSE 'marked_authorized' END END AS response,
         CASE WHEN refusal IS NULL AND decision_id IS NOT NULL THEN who END AS responder,
         CASE WHEN refusal IS NULL AND decision_id IS NOT NULL THEN coalesce('U' || who, '') END AS user_id, received_at FROM j""")
def feedback(spark, sf):
    d = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("track_id"), F.col("c_custkey").alias("decision_id"))
    ok, lost, refused = ac.ingest_feedback(_presses(spark, sf), d)
    none = F.lit(None).cast("string")
    return (ok.select(F.lit("stored").alias("state"), "response", "responder", "user_id", "received_at")
            .unionByName(lost.select(F.lit("unmatched").alias("state"), none.alias("response"), none.alias("responder"), none.alias("user_id"), "received_at"))
            .unionByName(refused.select(F.col("refusal").alias("state"), none.alias("response"), none.alias("responder"), none.alias("user_id"), "received_at")))


@query("j17_feedback_labels", f"""WITH p AS ({_PRESS.format(events='events')}), f AS (SELECT track_id, arg_max(action_id, received_at) AS a FROM p WHERE action_id <> 'other' AND track_id <> '' GROUP BY 1),
    t AS (SELECT CAST(c_custkey AS VARCHAR) AS track_id, CASE c_custkey % 2 WHEN 0 THEN 'drone' ELSE 'aircraft' END AS label FROM customer)
  SELECT track_id, CASE WHEN a = 'dismiss_as_bird' THEN 'bird' ELSE label END AS label, CASE WHEN a = 'dismiss_as_bird' THEN 'operator_confirmed' ELSE 'clip_provenance' END AS label_basis
  FROM t LEFT JOIN f USING (track_id)""")
def confirmed(spark, sf):
    c = F.col("c_custkey")
    t = table(spark, sf, "customer").select(c.cast("string").alias("track_id"), F.when(c % 2 == 0, "drone").otherwise("aircraft").alias("label"))
    ok, _, _ = ac.ingest_feedback(_presses(spark, sf), t.withColumn("decision_id", F.lit(1)))
    return ac.feedback_labels(ok, t)


_PROSE = """SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' We are Escalating this.' WHEN 1 THEN ' Dismissed; no action.' WHEN 2 THEN ' Continue tracking it.' WHEN 3 THEN ' watchful' ELSE '' END AS text,
    CASE conv_id % 3 WHEN 0 THEN 'dismiss' WHEN 1 THEN 'watch' ELSE 'escalate' END AS verdict FROM {conversations}"""


@query("j19_prose_contradicts", f"""WITH p AS ({_PROSE.format(conversations='conversations')})
  SELECT conv_id, turn, (verdict <> 'dismiss' AND regexp_matches(text, '(?i)\\b(dismiss(?:ing|ed|al)?|no action|stand(?:ing)? down)\\b'))
      OR (verdict <> 'escalate' AND regexp_matches(text, '(?i)\\b(escalat(?:e|ing|ed|ion)|paging|alert(?:ing)? the)\\b'))
      OR (verdict <> 'watch' AND regexp_matches(text, '(?i)\\b(watch(?:ing)?|monitor(?:ing)?|continue tracking)\\b')) AS contradicts FROM p""")
def prose(spark, sf):
    p = spark.sql(_PROSE, conversations=table(spark, sf, "conversations"))
    return p.select("conv_id", "turn", ac.prose_contradicts(F.col("text"), F.col("verdict")).alias("contradicts"))


@query("j20_sanitise_text", """SELECT doc_id, left(trim(regexp_replace(replace(replace(text, '<<<', ''), '>>>', ''),
  '[\\t\\n\\v\\f\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), 300) AS note FROM documents""")
def sanitised(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ac.sanitise_text(F.col("text"), 300, ("<<<", ">>>")).alias("note"))


# Odd denominators: no value lies on a tie of the rounding.
_JOB_MEASURES = "((l_orderkey * 7 + l_partkey) % 100003) / CAST(100003 AS DOUBLE) AS confidence, (l_partkey * 13 % 100003) / CAST(1003 AS DOUBLE) AS px, (l_orderkey * 31 % 100003) / CAST(3001 AS DOUBLE) AS speed"


@query("j21_job_summary", f"""SELECT l_suppkey AS job_id, CAST(count(*) AS INT) AS track_count, CAST(count(*) AS INT) AS listed, min(l_orderkey) AS first_number, bool_or(l_discount > 0.09) AS synthetic,
    min(round(confidence, 4)) AS min_confidence, max(round(confidence, 4)) AS max_confidence, max(round(px, 2)) AS max_pixels, min(round(speed, 4)) AS min_speed, max(round(speed, 4)) AS max_speed
  FROM (SELECT *, {_JOB_MEASURES} FROM lineitem) GROUP BY 1""")
def summaries(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("*", *_JOB_MEASURES.split(", ")).select(
        F.col("l_suppkey").alias("job_id"), F.col("l_orderkey").alias("track_number"), F.col("l_returnflag").alias("label"), "confidence",
        F.col("l_linenumber").alias("first_frame"), F.col("l_partkey").alias("last_frame"), F.col("px").alias("median_pixels_on_target"),
        F.col("speed").alias("mean_speed"), (F.col("l_discount") > 0.09).alias("synthetic"))
    rec = ac.job_summary(li, ["mean_speed"])
    part = lambda p: F.get_json_object("record", p)
    listed = F.from_json("record", "tracks array<struct<confidence:double,median_pixels_on_target:double,features:struct<mean_speed:double>>>")["tracks"]
    return rec.withColumn("t", listed).select(
        "job_id", part("$.track_count").cast("int").alias("track_count"), F.json_array_length(part("$.tracks")).alias("listed"),
        part("$.tracks[0].track_number").cast("long").alias("first_number"), (part("$.synthetic") == "true").alias("synthetic"),
        F.array_min("t.confidence").alias("min_confidence"), F.array_max("t.confidence").alias("max_confidence"), F.array_max("t.median_pixels_on_target").alias("max_pixels"),
        F.array_min("t.features.mean_speed").alias("min_speed"), F.array_max("t.features.mean_speed").alias("max_speed"))


@query("j22_overlay_rows", ctes("fx_observations") + """
  SELECT source_clip AS job_id, CAST(substr(track_id, 2) AS BIGINT) AS track_number, frame_index, round(sqrt((x2 - x1) * (y2 - y1)), 6) AS pixels_on_target,
         row_number() OVER (PARTITION BY track_id ORDER BY frame_index) - 1 < 2 AS forming,
         CASE WHEN CAST(substr(track_id, 2) AS BIGINT) % 7 > 0 THEN 'watch' END AS verdict, CASE WHEN CAST(substr(track_id, 2) AS BIGINT) % 7 > 0 THEN 'track too short' END AS caveat
  FROM fx_observations""")
def overlays(spark, sf):
    obs = view(spark, sf, "fx_observations").withColumns({"job_id": F.col("source_clip"), "track_number": F.substring("track_id", 2, 20).cast("long"), "score": F.lit(1.0)})
    d = obs.select("job_id", "track_number").distinct().where("track_number % 7 > 0").select(
        "job_id", F.concat_ws("-t", F.col("job_id").cast("string"), F.col("track_number").cast("string")).alias("track_id"),
        F.lit("watch").alias("verdict"), F.lit("watch.track_too_short").alias("rule_id"), F.lit("track_too_short").alias("uncertainty"))
    return ac.overlay_rows(obs, d).select("job_id", "track_number", "frame_index", F.round("pixels_on_target", 6).alias("pixels_on_target"), "forming", "verdict", "caveat")
