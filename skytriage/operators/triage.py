"""From features to one of three verdicts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from skytriage import constants as K
from skytriage.functions.numeric import fixed, round_all, round_py
from skytriage.operators.intervals import band_matches
from skytriage.operators.sweep import first_covering

# Decimals of each reported measure. Rules read the rounded numbers.
_DECIMALS = {
    "mean_speed": 3, "speed_variance": 4, "acceleration_variance": 4, "vertical_oscillation_hz": 3,
    "vertical_oscillation_power": 3, "heading_entropy": 3, "hover_fraction": 3, "trajectory_smoothness": 3,
    "scale_change_rate": 5,
}


def analyze_tracks(tracks: DataFrame) -> DataFrame:
    """Rounded measures per track and the state of the classifier.

    ``tracks`` has ``track_id, n_observations, duration_seconds,
    median_pixels_on_target``, the nine features (null when the track was too short) and
    ``classifier_trained, classifier_label, classifier_confidence, interval_low,
    interval_high``. Hover time is taken from the unrounded inputs.
    """
    width = F.col("interval_high") - F.col("interval_low")
    status = (F.when(~F.col("classifier_trained"), "no_classifier_trained")
              .when(width > K.MAX_DETERMINED_INTERVAL, "undetermined").otherwise("determined"))
    trained = F.col("classifier_trained")
    measures = {"duration_seconds": 2, "median_pixels_on_target": 1, **_DECIMALS, "classifier_confidence": 3, "interval_low": 3, "interval_high": 3}
    hover = F.col("hover_fraction") * F.col("duration_seconds")
    r = round_all([*[(F.col(f), d) for f, d in measures.items()], (hover, 2)])
    rounded = {f: F.get("_r", F.lit(k)) for k, f in enumerate([*measures, "hover_seconds"])}
    return tracks.select("*", r.alias("_r")).select(
        "track_id", "n_observations",
        *[rounded[f].alias(f) for f in ("duration_seconds", "median_pixels_on_target")],
        (F.col("median_pixels_on_target") >= K.SMALL_TARGET_PX).alias("appearance_reliable"),
        F.col("mean_speed").isNotNull().alias("features_available"),
        *[rounded[f].alias(f) for f in (*_DECIMALS, "hover_seconds")],
        status.alias("classifier_status"),
        F.when(trained, F.col("classifier_label")).alias("classifier_label"),
        *[F.when(trained, rounded[f]).alias(f) for f in ("classifier_confidence", "interval_low", "interval_high")])


def match_authorization(tracks: DataFrame, flights: DataFrame, sites: DataFrame) -> DataFrame:
    """Tracks with ``authorized, flight_id, operator, match_basis, site_known``.

    Of several flights covering the moment, the first in registry order (``ordinal``)
    counts. A site outside the registry vouches for nothing.
    """
    known = sites.select("site_id", F.lit(True).alias("site_known"))
    out = first_covering(tracks, flights, "site_id", "observed_at", "ordinal", ["flight_id", "operator"]).join(known, "site_id", "left")
    seen = F.coalesce(F.col("site_known"), F.lit(False))
    ok = seen & F.col("flight_id").isNotNull()
    return out.select(
        *tracks.columns, seen.alias("site_known"), ok.alias("authorized"),
        F.when(ok, F.col("flight_id")).alias("flight_id"), F.when(ok, F.col("operator")).alias("operator"),
        F.when(ok, "site_and_time_window").alias("match_basis"))


def zone_status(tracks: DataFrame, sites: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Tracks with ``site_known, zone_class, restriction_active, restriction_reason``."""
    known = sites.select("site_id", "zone_class", F.lit(True).alias("site_known"))
    out = first_covering(tracks, restrictions, "site_id", "observed_at", "ordinal", ["reason"]).join(known, "site_id", "left")
    seen = F.coalesce(F.col("site_known"), F.lit(False))
    active = seen & F.col("reason").isNotNull()
    return out.select(*tracks.columns, seen.alias("site_known"), "zone_class",
                      active.alias("restriction_active"), F.when(active, F.col("reason")).alias("restriction_reason"))


def query_history(tracks: DataFrame, history: DataFrame, now: dt.datetime, tol: float = 8.0, days: int = 30,
                  exclude_future: bool = False) -> DataFrame:
    """Tracks with ``match_count, matches, truncated`` over earlier tracks of the site, and the sizes searched.

    Age is counted in whole days, so a match may be up to a day older than the window;
    rows after ``now`` pass unless excluded. ``history`` has ``site_id, ordinal,
    track_id, observed_at, median_pixels_on_target, verdict``.
    """
    recent = history.where(F.col("observed_at") > F.lit(now) - F.make_dt_interval(F.lit(days + 1)))
    if exclude_future:
        recent = recent.where(F.col("observed_at") <= F.lit(now))
    shown = recent.withColumns({"prior_verdict": F.col("verdict"),
                                "px": round_py(F.col("median_pixels_on_target"), 1)})
    # Every track is answered: one without a site or a size matches nothing.
    out = band_matches(tracks, shown, "site_id", "median_pixels_on_target", tol, "ordinal",
                       ["track_id", "observed_at", "px", "prior_verdict"])
    px = F.col("median_pixels_on_target")
    return out.withColumns({"window_days": F.lit(days), "truncated": F.col("match_count") > 10,
                            "band_low_px": round_py(px - tol, 1), "band_high_px": round_py(px + tol, 1)})


def evidence_bounds(tracks: DataFrame, clips: DataFrame | None = None, pre: float = 3.0, post: float = 3.0) -> DataFrame:
    """Start and end seconds of the evidence clip, and its hash where a clip exists.

    ``clips`` has ``track_id, content`` (as read by the binary file source); the content
    is hashed before the join, so only digests are shuffled.
    """
    at = lambda c: F.when(F.col("fps") > 0, F.col(c) / F.col("fps")).otherwise(0.0)
    out = tracks.select(
        "track_id",
        round_py(F.greatest(F.lit(0.0), at("first_frame") - pre), 2).alias("start_seconds"),
        round_py(at("last_frame") + post, 2).alias("end_seconds"))
    if clips is None:
        return out.withColumns({"clip_exists": F.lit(False), "sha256": F.lit(None).cast("string")})
    digests = clips.select("track_id", F.sha2("content", 256).alias("sha256"))
    joined = out.join(digests, "track_id", "left")
    return joined.withColumn("clip_exists", F.col("sha256").isNotNull())


def assemble_evidence(calls: DataFrame) -> DataFrame:
    """Per track: last good result of every tool, and the tools that never succeeded.

    ``calls`` has ``track_id, seq, tool_name, ok, result``. A failure followed or
    preceded by a success of the same tool is no failure. Failed tools are listed in the
    order of their first failure.
    """
    good = F.col("ok") & F.col("result").isNotNull()
    per_tool = calls.groupBy("track_id", "tool_name").agg(
        F.max_by("result", F.when(good, F.col("seq"))).alias("result"), F.bool_or(good).alias("worked"),
        F.min(F.when(~F.col("ok"), F.col("seq"))).alias("failed_at"))
    failed = F.when(~F.col("worked") & F.col("failed_at").isNotNull(), F.struct("failed_at", "tool_name"))
    tools = ("analyze_track", "check_authorization", "check_airspace_zone", "query_history", "get_evidence_clip")
    return per_tool.groupBy("track_id").agg(
        F.transform(F.sort_array(F.collect_list(failed)), lambda f: f["tool_name"]).alias("failed_tools"),
        *[F.max(F.when((F.col("tool_name") == t) & F.col("worked"), F.col("result"))).alias(t) for t in tools])


# Rule -> (verdict, uncertainty, how attention is set). Fixed values, in rule order.
RULES = {
    "uncertain.tool_failure": ("escalate", "tool_failure", "prompt"),
    "uncertain.round_cap": ("escalate", "round_cap_reached", "prompt"),
    "uncertain.no_analysis": ("escalate", "tool_failure", "prompt"),
    "dismiss.authorized_flight": ("dismiss", "none", "routine"),
    "watch.track_too_short": ("watch", "track_too_short", "routine"),
    "watch.track_too_brief": ("watch", "track_too_short", "routine"),
    "escalate.sustained_hover": ("escalate", "none", "zone"),
    "dismiss.flapping_band": ("dismiss", "none", "routine"),
    "uncertain.no_classifier": ("escalate", "no_classifier_trained", "prompt"),
    "uncertain.classifier_undetermined": ("escalate", "classifier_undetermined", "prompt"),
    "uncertain.classifier_low_confidence": ("escalate", "classifier_low_confidence", "prompt"),
    "dismiss.classifier_non_drone": ("dismiss", "none", "routine"),
    "escalate.unexplained": ("escalate", "none", "zone"),
}


def _num(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _rule() -> Column:
    """The cascade: the first condition that holds names the rule; null never holds."""
    hz, power, hover = _num("vertical_oscillation_hz"), _num("vertical_oscillation_power"), _num("hover_seconds")
    status = F.col("classifier_status")
    low, high = K.FLAP_HZ
    confident = _num("classifier_confidence") >= K.MIN_DISMISS_CONFIDENCE
    other = (status == "determined") & F.col("classifier_label").isin("bird", "aircraft")
    cascade = [
        ("uncertain.tool_failure", F.size("failed_tools") > 0),
        ("uncertain.round_cap", F.col("round_cap_reached")),
        ("uncertain.no_analysis", ~F.col("has_analysis")),
        ("dismiss.authorized_flight", F.coalesce(F.col("authorized"), F.lit(False))),
        ("watch.track_too_short", ~F.coalesce(F.col("features_available"), F.lit(False))),
        ("watch.track_too_brief", _num("duration_seconds") < K.MIN_TRACK_SECONDS),
        ("escalate.sustained_hover", (hover >= K.MIN_HOVER_SECONDS) & (power < K.MIN_OSCILLATION_POWER)),
        ("dismiss.flapping_band", hz.between(low, high) & (power >= K.MIN_OSCILLATION_POWER)),
        ("uncertain.no_classifier", status == "no_classifier_trained"),
        ("uncertain.classifier_undetermined", status == "undetermined"),
        ("uncertain.classifier_low_confidence", other & ~confident),
        ("dismiss.classifier_non_drone", other),
    ]
    out = F.when(cascade[0][1], cascade[0][0])
    for name, cond in cascade[1:]:
        out = out.when(cond, name)
    return out.otherwise("escalate.unexplained")


def _by_rule(position: int) -> Column:
    table = F.create_map(*[F.lit(x) for rule, row in RULES.items() for x in (rule, row[position])])
    return F.element_at(table, F.col("rule_id"))


def _rationale() -> Column:
    """Measured values behind the rule, one sentence each, in a fixed order."""
    px, secs = _num("median_pixels_on_target"), _num("duration_seconds")
    measured = F.concat(fixed(px, 1), F.lit(" px over "), fixed(secs, 1), F.lit(" s"))
    flap = F.concat(F.lit("vertical oscillation "), fixed(_num("vertical_oscillation_hz"), 1), F.lit(" Hz, power share "),
                    fixed(_num("vertical_oscillation_power"), 2))
    hover = F.concat(F.lit("hover "), fixed(_num("hover_seconds"), 1), F.lit(" s"))
    says = F.concat(F.lit("classifier: "), F.col("classifier_label"), F.lit(" at "), fixed(_num("classifier_confidence"), 2))
    interval = F.format_string("interval [%s, %s]", F.col("interval_low").cast("string"), F.col("interval_high").cast("string"))
    zone = F.when(F.col("site_known").isNull(), F.array().cast("array<string>")).when(
        ~F.col("site_known"), F.array(F.lit("site not in registry"))).otherwise(F.array_compact(F.array(
            F.concat(F.lit("airspace: "), F.col("zone_class")),
            F.when(F.col("restriction_active"), F.concat(F.lit("restriction active: "), F.col("restriction_reason"))))))
    caveat = F.array_compact(F.array(F.when(
        (px > 0) & (px < K.SMALL_TARGET_PX),
        F.concat(fixed(px, 0), F.lit(f" px is below {K.SMALL_TARGET_PX:.0f} px: motion only, appearance unreliable")))))
    count = F.coalesce(F.col("history_count"), F.lit(0))
    history = F.array_compact(F.array(F.when(F.col("history_count").isNotNull(), F.when(
        count == 0, F.lit("no similar track at this site in the window")).otherwise(
        F.format_string("%d similar tracks at this site in %d days", count, F.col("history_days"))))))
    rule = F.col("rule_id")
    lines = lambda *c: F.array(*c)
    return (
        F.when(rule == "uncertain.tool_failure", lines(F.concat(F.lit("failed tools: "), F.array_join("failed_tools", ", "))))
        .when(rule == "uncertain.round_cap", lines(F.lit("round cap reached")))
        .when(rule == "uncertain.no_analysis", lines(F.lit("no track analysis")))
        .when(rule == "dismiss.authorized_flight", lines(
            measured, F.format_string("authorized flight %s (%s)", F.col("flight_id").cast("string"), F.col("operator")),
            F.lit("matched by site and time only")))
        .when(rule == "watch.track_too_short", lines(measured, F.lit("no motion features")))
        .when(rule == "watch.track_too_brief", lines(
            measured, F.concat(fixed(secs, 1), F.lit(f" s is below {K.MIN_TRACK_SECONDS:.0f} s"))))
        .when(rule == "escalate.sustained_hover", F.concat(lines(measured, hover, flap), zone, caveat))
        .when(rule == "dismiss.flapping_band", lines(measured, flap, hover, F.lit("flapping band is assumed, not fitted")))
        .when(rule == "uncertain.no_classifier", F.concat(lines(measured, F.lit("no trained classifier")), zone, caveat))
        .when(rule == "uncertain.classifier_undetermined", F.concat(lines(measured, F.concat(interval, F.lit(" too wide"))), zone, caveat))
        .when(rule == "uncertain.classifier_low_confidence", F.concat(lines(
            measured, F.concat(says, F.lit(f", below {K.MIN_DISMISS_CONFIDENCE:.2f}"))), zone, caveat))
        .when(rule == "dismiss.classifier_non_drone", lines(measured, F.concat(says, F.lit(", "), interval)))
        .otherwise(F.concat(lines(measured, F.lit("nothing explains this track")), zone, caveat, history)))


def decide(evidence: DataFrame) -> DataFrame:
    """One decision per evidence row: rule, verdict, uncertainty, attention, rationale.

    Attention is immediate only in restricted airspace or under an active restriction,
    and never for an uncertain outcome.
    """
    urgent = F.coalesce(F.col("restriction_active"), F.lit(False)) | F.coalesce(F.col("zone_class") == "restricted", F.lit(False))
    ruled = evidence.withColumn("rule_id", _rule())
    attention = F.when(_by_rule(2) == "zone", F.when(urgent, "immediate").otherwise("prompt")).otherwise(_by_rule(2))
    return ruled.withColumns({"verdict": _by_rule(0), "uncertainty": _by_rule(1), "attention": attention,
                              "rationale": _rationale()})


def first_decisions(decisions: DataFrame) -> DataFrame:
    """One decision per track: the earliest, whatever is decided again later.

    Aggregated rather than ranked, so repeated decisions collapse before the shuffle.
    """
    rest = [c for c in decisions.columns if c not in ("track_id", "created_at")]
    picked = decisions.groupBy("track_id").agg(F.min(F.struct("created_at", *rest)).alias("d"))
    return picked.select("track_id", "d.*")


def verdict_tallies(decisions: DataFrame) -> DataFrame:
    """Per rule: decisions per verdict, and escalations that came from uncertainty."""
    return decisions.groupBy("rule_id").agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("dismiss", "watch", "escalate")],
        F.count_if((F.col("verdict") == "escalate") & (F.col("uncertainty") != "none")).alias("uncertain_escalations"))
