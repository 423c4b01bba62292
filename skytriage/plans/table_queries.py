"""Stored records, the classifier and streaming forms (I1-I4, K, L)."""

from pyspark.sql import functions as F

from skytriage.constants import FEATURES
from skytriage.operators import classify, records
from skytriage.operators.association import TrackerConfig
from skytriage.plans.fixtures import ctes, table, view
from skytriage.plans.labelled_queries import labelled
from skytriage.plans.registry import query
from skytriage.plans.source_queries import _DECISION, _STATE, _labels, _write_runs, scratch
from skytriage.session import durable
from skytriage.sources import packs, runs
from skytriage.streaming import flows
from skytriage.streaming.tracker import stream_tracks


@query("i1_fit_gate", ctes("fx_observations") + """, t AS (SELECT DISTINCT track_id, label, source_clip FROM fx_observations), c AS (SELECT label, count(*) AS n FROM t GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS n_tracks, count(*) AS n_classes, min(n) AS smallest_class, (SELECT count(DISTINCT source_clip) FROM t) AS n_groups,
         CASE WHEN sum(n) < 20 THEN 'too few tracks' WHEN count(*) < 2 THEN 'fewer than two classes' END AS refusal FROM c""")
def gate(spark, sf):
    t = view(spark, sf, "fx_observations").select("track_id", "label", "source_clip").distinct()
    return classify.fit_gate(t).drop("warnings")


@query("i1_i2_fit_predict")
def fitted(spark, sf):
    t = durable(labelled(spark, sf))
    model, _ = classify.fit_motion_arm(t)
    return classify.predict(model, t).select("track_id", "label", "predicted")


@query("i3_permutation_importance")
def importance(spark, sf):
    t = durable(labelled(spark, sf))
    model, _ = classify.fit_motion_arm(t)
    return classify.permutation_importance(model, t)


_SEPARABLE = ctes("fx_observations") + """, t AS (SELECT track_id, label, source_clip, count(*) AS n FROM fx_observations GROUP BY 1, 2, 3)"""


def _separable(spark, sf):
    """One feature tells the classes apart by far, the others are constant: every right classifier agrees."""
    t = view(spark, sf, "fx_observations").groupBy("track_id", "label", "source_clip").agg(F.count("*").alias("n"))
    speed = F.when(F.col("label") == "bird", 100.0).when(F.col("label") == "drone", 200.0).otherwise(300.0) + F.col("n") % 7
    return durable(t.select("track_id", "label", "source_clip", *[(speed if f == "mean_speed" else F.lit(1.0)).alias(f) for f in FEATURES]))


@query("i2_separable_classes", f"{_SEPARABLE} SELECT track_id, label, label AS predicted, true AS sure, true AS adds_up FROM t")
def separable(spark, sf):
    t = _separable(spark, sf)
    out = classify.predict(classify.fit_motion_arm(t)[0], t)
    total = F.aggregate(F.map_values("probability"), F.lit(0.0), lambda a, x: a + x)
    return out.select("track_id", "label", "predicted", ((F.col("confidence") > 0.4) & (F.col("confidence") == F.col("probability")[F.col("predicted")])).alias("sure"),
                      (F.abs(total - 1) < 1e-6).alias("adds_up"))


@query("i3_lone_feature", "SELECT feature, feature <> 'mean_speed' AS is_zero, feature = 'mean_speed' AS is_largest FROM (SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature) WHERE (SELECT count(*) FROM events) > 0")
def lone_feature(spark, sf):
    t = _separable(spark, sf)
    imp = durable(classify.permutation_importance(classify.fit_motion_arm(t)[0], t))
    top = imp.agg(F.max("importance").alias("top")).withColumn("_one", F.lit(1))
    return imp.withColumn("_one", F.lit(1)).join(top, "_one").select("feature", (F.col("importance") == 0).alias("is_zero"), ((F.col("importance") == F.col("top")) & (F.col("top") > 0.3)).alias("is_largest"))


@query("i4_clip_folds", ctes("fx_observations") + """, c AS (SELECT DISTINCT source_clip FROM fx_observations)
  SELECT source_clip, CAST((row_number() OVER (ORDER BY sha256('1337:' || CAST(source_clip AS VARCHAR))) - 1) % 5 AS INT) AS fold FROM c""")
def folds(spark, sf):
    return classify.clip_folds(view(spark, sf, "fx_observations"), 5)


@query("i4_cross_validate", ctes("fx_observations") + """, c AS (SELECT DISTINCT source_clip FROM fx_observations),
    f AS (SELECT source_clip, CAST((row_number() OVER (ORDER BY sha256('1337:' || CAST(source_clip AS VARCHAR))) - 1) % 5 AS INT) AS fold FROM c)
  SELECT DISTINCT track_id, source_clip, fold, label, label AS predicted FROM fx_observations JOIN f USING (source_clip)""")
def validated(spark, sf):
    """Every track is predicted once, by a model that saw no track of its clip."""
    return classify.cross_validate(_separable(spark, sf)).select("track_id", "source_clip", "fold", "label", "predicted")


_VIDEOS = "SELECT o_orderkey AS video_id, o_custkey % 97 AS owner_id, o_orderdate AS created_at, CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes FROM {orders}"


@query("l1_l2_newest_videos", f"WITH v AS ({_VIDEOS.format(orders='orders')}) SELECT * FROM v WHERE owner_id = 7")
def newest(spark, sf):
    return records.newest_videos(spark.sql(_VIDEOS, orders=table(spark, sf, "orders")), 7)


@query("l3_job_results", """SELECT o_orderkey AS job_id, o_orderkey AS video_id, o_orderstatus AS status, CAST(l_linenumber AS INT) AS track_number, l_quantity AS speed
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 97 = 7""")
def results(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("video_id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 97).alias("owner_id"))
    tracks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("track_number"), F.to_json(F.struct(F.col("l_quantity").alias("speed"))).alias("features_json"))
    return records.job_results(jobs, tracks, 7, "speed double").select("job_id", "video_id", "status", "track_number", F.col("features.speed").alias("speed"))


@query("l4_decision_detail", """WITH d AS (SELECT c_custkey AS decision_id, c_nationkey AS owner_id, c_name FROM customer WHERE c_custkey = 3)
  SELECT d.decision_id, d.owner_id, count(o.o_orderkey) AS n_feedback, min(o.o_orderdate) AS first_at FROM d LEFT JOIN orders o ON o.o_custkey = d.decision_id GROUP BY 1, 2""")
def detail(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("decision_id"), F.col("c_nationkey").alias("owner_id"))
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("decision_id"), F.col("o_orderdate").alias("received_at"), F.col("o_orderstatus").alias("response"), F.col("o_orderpriority").alias("responder"))
    owner = d.where("decision_id = 3").first()["owner_id"]
    return records.decision_detail(d, f, owner, 3).select("decision_id", "owner_id", F.size("feedback").cast("long").alias("n_feedback"), F.col("feedback")[0]["received_at"].alias("first_at"))


@query("l4_job_decisions", """SELECT l_linenumber AS decision_id, l_suppkey AS job_id, l_partkey % 5 AS owner_id, l_shipdate AS created_at FROM lineitem WHERE l_partkey % 5 = 2 AND l_suppkey = 3""")
def decisions(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("decision_id"), F.col("l_suppkey").alias("job_id"), (F.col("l_partkey") % 5).alias("owner_id"), F.col("l_shipdate").alias("created_at"))
    return records.job_decisions(d, 2, 3)


@query("l5_quota_usage", f"""WITH v AS ({_VIDEOS.format(orders='orders')}), o AS (SELECT c_custkey AS owner_id, CAST(c_custkey AS BIGINT) * 100000000 AS quota_bytes FROM customer)
  SELECT o.owner_id, o.quota_bytes, CAST(coalesce(sum(v.size_bytes), 0) AS BIGINT) AS used_bytes, coalesce(sum(v.size_bytes), 0) > o.quota_bytes AS over_quota FROM o LEFT JOIN v USING (owner_id) GROUP BY 1, 2""")
def quota(spark, sf):
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("owner_id"), (F.col("c_custkey") * 100000000).alias("quota_bytes"))
    return records.quota_usage(spark.sql(_VIDEOS, orders=table(spark, sf, "orders")), owners)


@query("l6_redact", """SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE substr(c_name, 1, 8) || '...' END AS token,
  substr(c_mktsegment, 1, 8) || CASE WHEN length(c_mktsegment) > 8 THEN '...' ELSE '' END AS prefix, CASE WHEN length(c_mktsegment) <= 8 THEN repeat('*', length(c_mktsegment)) ELSE substr(c_mktsegment, 1, 8) || '...' END AS secret,
  c_mktsegment AS plain FROM customer""")
def redacted(spark, sf):
    c = table(spark, sf, "customer")
    log = c.select("c_custkey", F.col("c_name").alias("token"), F.struct(F.struct(F.col("c_mktsegment").alias("secret"), F.col("c_mktsegment").alias("plain")).alias("inner")).alias("fields"))
    out = records.redact(log).select("c_custkey", "token", F.col("fields.inner.secret").alias("secret"), F.col("fields.inner.plain").alias("plain"))
    return out.withColumn("prefix", F.concat(F.substring("plain", 1, 8), F.when(F.length("plain") > 8, "...").otherwise("")))


@query("l7_lockout_streaks", """WITH l AS (SELECT user_id AS account, event_id AS attempt_id, value > 25 AS ok, ts FROM events),
    g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY account ORDER BY ts, attempt_id) AS grp FROM l),
    s AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY account, grp ORDER BY ts, attempt_id) AS n FROM g)
  SELECT account, attempt_id, n AS consecutive_failures, CASE WHEN n > 3 THEN least(pow(2, n - 4), 900) ELSE 0.0 END AS delay_seconds FROM s""")
def streaks(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("account"), F.col("ts").alias("at"), F.col("event_id").alias("attempt_id"), (F.col("value") > 25).alias("ok"))
    return records.lockout_streaks(e).select("account", "attempt_id", "consecutive_failures", "delay_seconds")


# --- streaming ------------------------------------------------------------------
def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
            .withColumn("ts", F.col("ts").cast("timestamp")))


@query("k2_job_progress", """SELECT user_id AS job_id, CAST(floor((max(event_id) + 1) / 30) * 30 AS BIGINT) AS frames_done, 0.0::DOUBLE AS progress FROM events GROUP BY 1""")
def progress(spark, sf):
    s = _event_stream(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("frame_index"))
    out = flows.run_to_table(flows.job_progress(s), scratch(spark), "update")
    return out.groupBy("job_id").agg(F.max("frames_done").alias("frames_done"), F.max("progress").alias("progress"))


@query("k2_progress_share", """WITH d AS (SELECT user_id AS job_id, CAST(floor((max(event_id) + 1) / 30) * 30 AS BIGINT) AS frames_done, count(*) AS n FROM events GROUP BY 1)
  SELECT job_id, frames_done, CASE WHEN job_id % 5 IN (0, 1) THEN 0.0 WHEN job_id % 5 = 2 THEN 1.0 ELSE round(least(1.0, frames_done::DOUBLE / (n * 200)), 9) END::DOUBLE AS progress FROM d""")
def progress_share(spark, sf):
    """Jobs of unknown, zero, short and long totals, the last of which are not done yet or just so."""
    job = F.col("user_id")
    n = F.when(job % 5 == 1, 0).when(job % 5 == 2, 1).otherwise(F.count("*") * 200)
    totals = table(spark, sf, "events").groupBy("user_id").agg(n.alias("n_frames")).where(job % 5 != 0).select(job.alias("job_id"), "n_frames")
    s = _event_stream(spark, sf).select(job.alias("job_id"), F.col("event_id").alias("frame_index"))
    out = flows.run_to_table(flows.job_progress(s, totals), scratch(spark), "update")
    return out.groupBy("job_id").agg(F.max("frames_done").alias("frames_done"), F.round(F.max("progress"), 9).alias("progress"))


@query("k3_stream_false_alarms", """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) FILTER (value / 60 >= 0.5) AS n_false_alarms, count(*) AS n_frames, count(*) / 30.0 AS seconds FROM events GROUP BY 1)
  SELECT start, n_false_alarms, n_frames, round(seconds, 6) AS seconds, round(n_false_alarms / (seconds / 3600), 4) AS per_hour FROM w WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def alarm_stream(spark, sf):
    det = _event_stream(spark, sf).select("ts", (F.col("value") / 60).alias("score"))
    frames = _event_stream(spark, sf).select("ts", F.lit(30.0).alias("fps"))
    out = flows.run_to_table(flows.stream_false_alarms(det, frames, 0.5), scratch(spark))
    return out.select("start", "n_false_alarms", "n_frames", F.round("seconds", 6).alias("seconds"), F.round("per_hour", 4).alias("per_hour"))


@query("k3_late_rows", """WITH p AS (SELECT ts, CAST(extract('day' FROM ts) AS INT) % 3 AS part FROM events),
    m AS (SELECT part, max(ts) AS latest, count(*) AS n FROM p GROUP BY 1),
    w AS (SELECT part, n, (SELECT max(latest) FROM m e WHERE e.part < m.part) - INTERVAL '10 minutes' AS watermark FROM m)
  SELECT CAST(w.part AS BIGINT) AS batch, any_value(w.n) AS n_rows, count(*) FILTER (time_bucket(INTERVAL '1 hour', p.ts) + INTERVAL '1 hour' <= w.watermark) AS n_late
  FROM p JOIN w USING (part) GROUP BY 1""")
def late_rows(spark, sf):
    """Every third day arrives together, so most of what comes after the first part is late."""
    path = scratch(spark)
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    for part in range(3):
        events.where(F.dayofmonth("ts") % 3 == part).write.parquet(f"{path}/in/part={part}")
        arriving = spark.readStream.schema("ts timestamp, event_id bigint").parquet(f"{path}/in/part=*")
        flows.report_late(arriving.select("ts", "event_id"), f"{path}/late", f"{path}/log").awaitTermination()
    return spark.read.schema("n_rows bigint, n_late bigint, batch bigint").parquet(f"{path}/late/counts").select("batch", "n_rows", "n_late")


_KIND = "user_id % 8"


# Eight kinds of tracks, each of which another rule settles: authorised, thinned out, hovering, or moving evenly with all states of the classifier.
@query("k4_reevaluate", f"""WITH o AS (SELECT user_id, {_KIND} AS kind, count(*) AS n FROM events WHERE {_KIND} <> 1 OR event_id % 16 = 0 GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN kind = 0 THEN 'dismiss.authorized_flight' WHEN n < 8 THEN 'watch.track_too_short' WHEN kind IN (1, 3) THEN 'escalate.sustained_hover' WHEN kind IN (2, 4) THEN 'uncertain.no_classifier'
      WHEN kind = 5 THEN 'uncertain.classifier_undetermined' WHEN kind = 6 THEN 'uncertain.classifier_low_confidence' WHEN user_id % 16 = 7 THEN 'dismiss.classifier_non_drone' ELSE 'escalate.unexplained' END AS rule_id FROM o)
  SELECT 't' || user_id AS track_id, n AS n_observations, rule_id, CASE WHEN rule_id LIKE 'dismiss%' THEN 'dismiss' WHEN rule_id LIKE 'watch%' THEN 'watch' ELSE 'escalate' END AS verdict,
         CASE WHEN rule_id LIKE 'escalate%' THEN CASE WHEN user_id % 3 = 0 THEN 'immediate' ELSE 'prompt' END WHEN rule_id LIKE 'uncertain%' THEN 'prompt' ELSE 'routine' END AS attention FROM r""")
def reevaluated(spark, sf):
    path = scratch(spark)
    kind = F.expr(_KIND)
    obs = _event_stream(spark, sf).where((kind != 1) | (F.col("event_id") % 16 == 0)).select(
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("track_id"), F.col("event_id").alias("frame_index"),
        F.when(kind.isin(1, 3), 7.0).otherwise(F.col("event_id") * 5.0).alias("x1")).select(
        "track_id", "frame_index", "x1", F.lit(0.0).alias("y1"), (F.col("x1") + 9).alias("x2"), F.lit(9.0).alias("y2"))

    def context(ids, batch_id):
        user = F.substring("track_id", 2, 20).cast("long")
        kind = user % 8
        return ids.select(
            "track_id", (kind == 0).alias("authorized"), F.when(kind == 0, "f1").alias("flight_id"), F.lit(True).alias("site_known"), F.when(user % 3 == 0, "restricted").otherwise("unrestricted").alias("zone_class"),
            (kind >= 5).alias("classifier_trained"), F.when(user % 16 == 7, "aircraft").when(user % 16 == 15, "drone").otherwise("bird").alias("classifier_label"),
            F.when(kind == 6, 0.1).otherwise(0.99).alias("classifier_confidence"), F.when(kind == 5, 0.0).otherwise(0.9).alias("interval_low"), F.when(kind == 5, 1.0).otherwise(0.95).alias("interval_high"))

    flows.stream_reevaluate(obs, f"{path}/history", f"{path}/out", f"{path}/log", context=context).awaitTermination()
    return flows.latest_decisions(spark, f"{path}/out").select("track_id", "n_observations", "rule_id", "verdict", "attention")


@query("k5_once_per_track", "SELECT user_id AS track_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def once(spark, sf):
    s = _event_stream(spark, sf).select(F.col("user_id").alias("track_id"), F.col("ts").alias("created_at"), "event_type")
    return flows.run_to_table(flows.once_per_track(s, "100000 hours"), scratch(spark)).groupBy("track_id").agg(F.count("*").alias("n"))


@query("k5_j12_decide_once", """WITH p AS (SELECT *, CAST(extract('hour' FROM ts) AS INT) // 8 AS part FROM events)
  SELECT user_id AS track_id, arg_min(event_id, (part, ts, event_id)) AS event_id, count(*) AS n_repeats FROM p GROUP BY 1""")
def decided_once(spark, sf):
    """Decisions arrive in three parts, each hours and days out of order with the others; the first to arrive stays."""
    path, shape = scratch(spark), "track_id bigint, created_at timestamp, event_id bigint"
    events = table(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_id")
    for part in range(3):
        events.where(F.floor(F.hour("created_at") / 8) == part).write.parquet(f"{path}/in/part={part}")
        arriving = spark.readStream.schema(shape).parquet(f"{path}/in/part=*")
        flows.decide_once(arriving.select("track_id", "created_at", "event_id"), f"{path}/store", f"{path}/log").awaitTermination()
    kept = flows.first_decisions(spark, shape, f"{path}/store").select("track_id", "event_id")
    return kept.join(events.groupBy("track_id").agg(F.count("*").alias("n_repeats")), "track_id")


@query("k6_stream_ingest_runs", f"""WITH d AS ({_DECISION.format(events='events')}), s AS (SELECT *, {_STATE} AS st FROM d) SELECT CAST(event_id AS VARCHAR) AS track_id, CAST(run AS VARCHAR) AS source_clip FROM s WHERE st = 'kept'""")
def ingest_stream(spark, sf):
    path = scratch(spark)
    _write_runs(spark, sf, f"{path}/runs{packs.SUFFIX}")
    labels = _labels(spark, sf, F.lit("drone"))
    flows.stream_ingest_runs(spark, f"{path}/runs{packs.SUFFIX}", labels, f"{path}/store", f"{path}/log").awaitTermination()
    return runs.load_tracks(spark, f"{path}/store")[0].select("track_id", "source_clip")


@query("k7_activity_sessions", """WITH l AS (SELECT user_id AS source_video, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY source_video ORDER BY ts) AS s FROM l),
    w AS (SELECT source_video, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n_detections FROM g GROUP BY source_video, s)
  SELECT * FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def sessions(spark, sf):
    s = _event_stream(spark, sf).select("ts", F.col("user_id").alias("source_video"))
    return flows.run_to_table(flows.activity_sessions(s, "6 hours"), scratch(spark))


@query("k1_stream_tracks")
def track_stream(spark, sf):
    # Events drift slowly through the frame of their user, one per frame number.
    k = F.col("event_id")
    s = _event_stream(spark, sf).select(
        (F.col("user_id") % 10).alias("source_video"), "ts", k.alias("frame_index"), F.lit(1).cast("long").alias("det_index"),
        (k * 0.01).alias("x1"), F.lit(10.0).alias("y1"), (k * 0.01 + 20).alias("x2"), F.lit(30.0).alias("y2"), F.lit(0.9).alias("score"))
    return flows.run_to_table(stream_tracks(s, TrackerConfig(), "1 minute"), scratch(spark))
