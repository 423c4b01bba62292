"""What follows a decision: routing, budgets, incidents, feedback, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skytriage.constants import ACTION_BUDGET
from skytriage.functions.geometry import corners, pixels_on_target
from skytriage.functions.numeric import round_py

ALERT_CHANNEL, AUDIT_CHANNEL = "#airspace-alerts", "#airspace-audit"

# Button -> stored response. Fixed values.
RESPONSES = {"confirm": "confirmed", "dismiss_as_bird": "dismissed_as_bird", "mark_authorized": "marked_authorized"}

# Phrases that claim a verdict, as patterns. Fixed values.
CLAIMS = {
    "dismiss": r"(?i)\b(dismiss(?:ing|ed|al)?|no action|stand(?:ing)? down)\b",
    "escalate": r"(?i)\b(escalat(?:e|ing|ed|ion)|paging|alert(?:ing)? the)\b",
    "watch": r"(?i)\b(watch(?:ing)?|monitor(?:ing)?|continue tracking)\b",
}

# Markers removed from free text. Fixed values.
FENCES = ("<<<UNTRUSTED_OPERATOR_DATA>>>", "<<<END_UNTRUSTED_OPERATOR_DATA>>>",
          "<<<UNTRUSTED_USER_DATA>>>", "<<<END_UNTRUSTED_USER_DATA>>>")

# Every character that counts as white space in Unicode text.
WHITE_SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# Short caption per kind of uncertainty; an unknown kind fails instead of going unmarked.
CAVEATS = {
    "none": None, "classifier_undetermined": "classifier undetermined", "track_too_short": "track too short",
    "tool_failure": "tool failure", "round_cap_reached": "round cap reached",
    "no_classifier_trained": "no classifier trained", "classifier_low_confidence": "classifier low confidence",
}


def canonical_json(col: Column, dtype: T.DataType) -> Column:
    """JSON text of a value with object keys in name order and nulls kept."""
    def ordered(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)])
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: ordered(x, t.elementType))
        return c

    return F.to_json(ordered(col, dtype), {"ignoreNullFields": "false"})


def with_audit_hash(decisions: DataFrame) -> DataFrame:
    """Adds ``audit_hash``: sha256 over the record without its timings, keys in name order."""
    skip = ("duration_ms", "created_at")
    fields = [f for f in decisions.schema.fields if f.name not in skip]
    calls = next((f for f in fields if f.name == "tool_calls"), None)
    parts, types = [], []
    for f in fields:
        col, kind = F.col(f.name), f.dataType
        if calls is not None and f.name == "tool_calls":
            kept = [s for s in kind.elementType.fields if s.name not in skip]
            col = F.transform(col, lambda c: F.struct(*[c[s.name].alias(s.name) for s in kept]))
            kind = T.ArrayType(T.StructType(kept))
        parts.append(col.alias(f.name))
        types.append(T.StructField(f.name, kind))
    text = canonical_json(F.struct(*parts), T.StructType(types))
    return decisions.withColumn("audit_hash", F.sha2(text, 256))


def route_notifications(decisions: DataFrame, posted: DataFrame, watch_channel: str = ALERT_CHANNEL) -> DataFrame:
    """Reference, channel and whether the message updates one already posted."""
    dismissed = F.col("verdict") == "dismiss"
    ref = F.concat(F.when(dismissed, "local-dismiss-").otherwise("local-"), F.col("track_id"))
    channel = (F.when(dismissed, AUDIT_CHANNEL).when(F.col("verdict") == "watch", watch_channel).otherwise(ALERT_CHANNEL))
    known = posted.select("ref").distinct().withColumn("_old", F.lit(True))
    return decisions.select("track_id", "verdict", ref.alias("ref"), channel.alias("channel")).join(
        known, "ref", "left").withColumn("updated", F.coalesce(F.col("_old"), F.lit(False))).drop("_old")


def apply_budget(actions: DataFrame, limit: int = ACTION_BUDGET) -> DataFrame:
    """Actions with ``outcome``: allowed, then one budget refusal, then circuit refusals.

    ``actions`` has ``site_id, run_id, seq`` (unique per run). Only the sequence numbers
    of the first ``limit + 1`` actions of a run are needed; the ranking filter cuts each
    map task to that many rows per run before anything is shuffled.
    """
    keys = ["site_id", "run_id"]
    w = Window.partitionBy(*keys).orderBy("seq")
    head = actions.select(*keys, "seq").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit + 1)
    cuts = head.groupBy(*keys).agg(
        F.max(F.when(F.col("_n") <= limit, F.col("seq"))).alias("_last"),
        F.max(F.when(F.col("_n") == limit + 1, F.col("seq"))).alias("_tripped"))
    outcome = (F.when(F.col("seq") <= F.col("_last"), "allowed")
               .when(F.col("seq") == F.col("_tripped"), "budget_exhausted").otherwise("circuit_open"))
    return actions.join(cuts, keys).withColumn("outcome", outcome).drop("_last", "_tripped")


def open_incidents(actions: DataFrame) -> DataFrame:
    """One incident per track, taken from its first request; the id is a hash of the track."""
    first = actions.groupBy("track_id").agg(F.min(F.struct("seq", "summary")).alias("a"), F.count("*").alias("n_requests"))
    return first.select(F.substring(F.sha2(F.concat(F.lit("incident:"), F.col("track_id")), 256), 1, 32).alias("incident_id"),
                        "track_id", F.col("a.summary").alias("summary"), "n_requests")


_PAYLOAD = ("actions array<struct<action_id:string,value:string>>, user struct<id:string,name:string,username:string>,"
            " message struct<ts:string>, response_url string")


def ingest_feedback(payloads: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feedback joined to decisions, feedback for unknown tracks, refused payloads).

    ``payloads`` has ``payload`` (JSON text of one button press) and ``received_at``. Feedback
    names who pressed (``responder``, ``user_id``) and where to answer (``response_url``, ``message_ts``).
    """
    body = F.from_json("payload", _PAYLOAD)
    read = payloads.withColumn("_b", body).withColumn("_a", F.get(F.col("_b.actions"), F.lit(0)))
    table = F.create_map(*[F.lit(x) for kv in RESPONSES.items() for x in kv])
    parsed = read.select(
        "payload", "received_at", F.col("_a.action_id").alias("action_id"),
        F.substring(F.coalesce(F.col("_a.value"), F.lit("")), 1, 64).alias("track_id"),
        F.substring(F.coalesce(F.col("_b.user.id"), F.lit("")), 1, 64).alias("user_id"),
        F.substring(F.col("_b.response_url"), 1, 500).alias("response_url"), F.nullif(F.col("_b.message.ts"), F.lit("")).alias("message_ts"),
        F.substring(F.coalesce(F.col("_b.user.name"), F.col("_b.user.username"), F.lit("unknown")), 1, 128).alias("responder"),
        F.try_element_at(table, F.col("_a.action_id")).alias("response"),
        F.when(F.col("payload").isNull(), "payload is missing")
        .when(F.col("_a").isNull(), "no action").when(~F.coalesce(F.col("_a.action_id"), F.lit("")).isin(*RESPONSES), "unrecognised action")
        .when(F.coalesce(F.col("_a.value"), F.lit("")) == "", "no track id").alias("refusal"))
    refused = parsed.where("refusal IS NOT NULL").select("payload", "received_at", "refusal")
    good = parsed.where("refusal IS NULL").drop("refusal", "payload")
    matched = good.join(decisions.select("track_id", "decision_id"), "track_id")
    unmatched = good.join(decisions.select("track_id"), "track_id", "left_anti")
    return matched, unmatched, refused


def feedback_labels(feedback: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks with the label to use and its basis.

    A press on one track outranks the assertion about its whole clip, and the latest
    press counts; the decision itself is left as it was. Only "dismissed as bird" names
    a class; other responses say nothing about it and leave label and basis alone.
    """
    latest = feedback.groupBy("track_id").agg(F.max(F.struct("received_at", "response")).alias("f"))
    confirmed = F.coalesce(F.col("f.response") == "dismissed_as_bird", F.lit(False))
    return tracks.join(latest, "track_id", "left").select(
        *[c for c in tracks.columns if c not in ("label", "label_basis")],
        F.when(confirmed, "bird").otherwise(F.col("label")).alias("label"),
        F.when(confirmed, "operator_confirmed").otherwise("clip_provenance").alias("label_basis"))


def prose_contradicts(text: Column, verdict: Column) -> Column:
    """True if the text explicitly claims a verdict other than the computed one."""
    hit = F.lit(False)
    for name, pattern in CLAIMS.items():
        hit = hit | ((verdict != name) & text.rlike(pattern))
    return hit


def sanitise_text(text: Column, limit: int, fences: tuple[str, ...] = FENCES) -> Column:
    """Text without fence markers, white space collapsed, cut to ``limit`` characters."""
    for mark in fences:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.left(F.trim(F.regexp_replace(text, WHITE_SPACE, " ")), F.lit(limit))


def job_summary(tracks: DataFrame, features: list[str]) -> DataFrame:
    """Per job: one JSON record of its tracks in number order, with rounded measures.

    The record is the feature itself, so a job's tracks meet in one row; a job is one
    video, whose length the media limits bound.
    """
    entry = F.struct(
        "track_number", "label", round_py(F.col("confidence"), 4).alias("confidence"), "first_frame", "last_frame",
        round_py(F.col("median_pixels_on_target"), 2).alias("median_pixels_on_target"),
        F.struct(*[round_py(F.col(f), 4).alias(f) for f in features]).alias("features"))
    return tracks.groupBy("job_id").agg(
        F.count("*").alias("track_count"), F.bool_or("synthetic").alias("synthetic"),
        F.sort_array(F.collect_list(entry)).alias("tracks")).select(
        "job_id", F.to_json(F.struct("synthetic", "track_count", "tracks")).alias("record"))


def overlay_rows(obs: DataFrame, decisions: DataFrame, min_hits: int = 3) -> DataFrame:
    """Every observation with the verdict of its track, for drawing.

    ``obs`` has ``job_id, track_number, frame_index`` and a box; ``decisions`` has
    ``job_id, track_id`` where the id is ``<job>-t<number>``, checked rather than assumed.
    Observations made before a track had enough hits are marked as forming: those up to
    the frame of the hit before. Only these first frames are ranked, and Spark cuts every
    partition to them before the shuffle.
    """
    keys = ["job_id", "track_number"]
    number = F.regexp_extract("track_id", r"-t(\d+)$", 1)
    fits = F.col("track_id") == F.concat(F.col("job_id").cast("string"), F.lit("-t"), number)
    bad = F.raise_error(F.concat(F.lit("decision does not belong to its job: "), F.col("track_id"))).cast("long")
    kinds = list(CAVEATS)
    caveat = F.element_at(F.create_map(*[x for k in kinds for x in (F.lit(k), F.lit(CAVEATS[k]).cast("string"))]), F.col("uncertainty"))
    marked = F.when(F.col("uncertainty").isin(*kinds), caveat).otherwise(
        F.raise_error(F.concat(F.lit("no caption for uncertainty "), F.col("uncertainty"))).cast("string"))
    verdicts = decisions.select("job_id", F.when(fits & (number != ""), number.cast("long")).otherwise(bad).alias("track_number"),
                                "verdict", "rule_id", marked.alias("caveat"))
    w = Window.partitionBy(*keys).orderBy("frame_index")
    early = obs.select(*keys, "frame_index").withColumn("_k", F.row_number().over(w)).where(F.col("_k") < min_hits)
    formed = early.groupBy(*keys).agg(F.max("frame_index").alias("_formed"))
    placed = obs.join(formed, keys, "left")
    return placed.join(verdicts, keys, "left").select(
        *keys, "frame_index", "score", pixels_on_target(corners()).alias("pixels_on_target"),
        F.coalesce(F.col("frame_index") <= F.col("_formed"), F.lit(False)).alias("forming"), "verdict", "rule_id", "caveat")
