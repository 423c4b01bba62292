"""Rule order, attention and action records on hand-made rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from skytriage.operators import actions as ac, triage as tr

BASE = {"failed_tools": [], "round_cap_reached": False, "has_analysis": True, "duration_seconds": 10.0, "median_pixels_on_target": 24.0, "features_available": True,
        "vertical_oscillation_hz": 0.5, "vertical_oscillation_power": 0.1, "hover_seconds": 0.0, "classifier_status": "no_classifier_trained", "classifier_label": None,
        "classifier_confidence": None, "interval_low": None, "interval_high": None, "authorized": False, "flight_id": "f", "operator": "op", "site_known": True,
        "zone_class": "open", "restriction_active": False, "restriction_reason": None, "history_count": 2, "history_days": 30}
SCHEMA = ("failed_tools array<string>, round_cap_reached boolean, has_analysis boolean, duration_seconds double, median_pixels_on_target double, features_available boolean, "
          "vertical_oscillation_hz double, vertical_oscillation_power double, hover_seconds double, classifier_status string, classifier_label string, classifier_confidence double, "
          "interval_low double, interval_high double, authorized boolean, flight_id string, operator string, site_known boolean, zone_class string, restriction_active boolean, "
          "restriction_reason string, history_count long, history_days int")
CASES = [
    ({"failed_tools": ["zone"], "authorized": True}, "uncertain.tool_failure", "prompt"), ({"round_cap_reached": True}, "uncertain.round_cap", "prompt"),
    ({"has_analysis": False, "authorized": True}, "uncertain.no_analysis", "prompt"), ({"authorized": True, "features_available": False}, "dismiss.authorized_flight", "routine"),
    ({"features_available": False}, "watch.track_too_short", "routine"), ({"duration_seconds": 1.99}, "watch.track_too_brief", "routine"),
    ({"duration_seconds": 2.0, "hover_seconds": 3.0, "zone_class": "restricted"}, "escalate.sustained_hover", "immediate"),
    ({"hover_seconds": 3.0, "vertical_oscillation_power": 0.35, "vertical_oscillation_hz": 2.0}, "dismiss.flapping_band", "routine"),
    ({"vertical_oscillation_power": 0.9, "vertical_oscillation_hz": 8.01}, "uncertain.no_classifier", "prompt"),
    ({"zone_class": "restricted"}, "uncertain.no_classifier", "prompt"), ({"classifier_status": "undetermined"}, "uncertain.classifier_undetermined", "prompt"),
    ({"classifier_status": "determined", "classifier_label": "bird", "classifier_confidence": 0.74}, "uncertain.classifier_low_confidence", "prompt"),
    ({"classifier_status": "determined", "classifier_label": "bird", "classifier_confidence": 0.75}, "dismiss.classifier_non_drone", "routine"),
    ({"classifier_status": "determined", "classifier_label": "drone", "classifier_confidence": 0.99}, "escalate.unexplained", "prompt"),
    ({"classifier_status": "determined", "classifier_label": "drone", "restriction_active": True}, "escalate.unexplained", "immediate"),
    ({"classifier_status": "determined", "classifier_label": "drone", "zone_class": None, "site_known": None}, "escalate.unexplained", "prompt"),
]


def test_cascade(spark):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = [tuple((BASE | c)[n] for n in names) + (i,) for i, (c, _, _) in enumerate(CASES)]
    got = {r.i: r for r in tr.decide(spark.createDataFrame(rows, SCHEMA + ", i int")).collect()}
    for i, (_, rule, attention) in enumerate(CASES):
        assert (got[i].rule_id, got[i].attention) == (rule, attention), i
        assert got[i].verdict in ("dismiss", "watch", "escalate") and got[i].rationale
        assert not (got[i].uncertainty != "none" and got[i].verdict == "dismiss")
    assert got[13].rationale[-1] == "2 similar tracks at this site in 30 days"


def test_audit_hash_ignores_timings(spark):
    def rec(ms, verdict):
        call = F.struct(F.lit("x").alias("tool_name"), F.lit(ms).alias("duration_ms"))
        return spark.range(1).select(F.lit("t").alias("track_id"), F.lit(verdict).alias("verdict"), F.array(call).alias("tool_calls"), F.lit(ms).alias("created_at"))
    h = [ac.with_audit_hash(rec(*a)).first().audit_hash for a in ((1, "watch"), (2, "watch"), (1, "dismiss"))]
    assert h[0] == h[1] != h[2]


def test_overlay_checks_its_ids(spark):
    obs = spark.createDataFrame([("j", 1, f, 0.0, 0.0, 4.0, 4.0, 0.9) for f in range(5)], "job_id string, track_number long, frame_index long, x1 double, y1 double, x2 double, y2 double, score double")
    def run(track_id, uncertainty="none", min_hits=3):
        d = spark.createDataFrame([("j", track_id, "watch", "r", uncertainty)], "job_id string, track_id string, verdict string, rule_id string, uncertainty string")
        return ac.overlay_rows(obs, d, min_hits).orderBy("frame_index").collect()
    for hits, forming in ((3, 2), (1, 0), (0, 0), (9, 5)):
        assert [r.forming for r in run("j-t1", min_hits=hits)] == [True] * forming + [False] * (5 - forming)
    for bad in (("k-t1",), ("j-tx",), ("j-t1", "strange")):
        with pytest.raises(Exception, match="does not belong|no caption"):
            run(*bad)


def test_text_rules(spark):
    df = spark.createDataFrame([("We are escalating.", "dismiss", True), ("Escalation confirmed", "escalate", False), ("a watchful eye", "dismiss", False), ("No action needed", "watch", True)], "t string, v string, want boolean")
    assert all(r.got == r.want for r in df.select("want", ac.prose_contradicts(F.col("t"), F.col("v")).alias("got")).collect())
    r = spark.createDataFrame([("  a <<<UNTRUSTED_OPERATOR_DATA>>>\n b\t c ",)], "t string").select(ac.sanitise_text(F.col("t"), 4).alias("x")).first()
    assert r.x == "a b "


def _shuffled_records(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_history_blocks_follow_the_history_not_the_sizes_asked_for(spark):
    now = dt.datetime(2024, 3, 1, 12, tzinfo=dt.timezone.utc)
    stored = spark.range(1500).select(F.lit(1).alias("site_id"), ((F.col("id") * 7919) % 1500).alias("ordinal"), F.col("id").cast("string").alias("track_id"), F.lit(now).alias("observed_at"),
                                     F.floor(F.col("id") / 10).cast("double").alias("median_pixels_on_target"), F.lit("watch").alias("verdict"))
    tracks = spark.range(4000).select("id", F.when(F.col("id") % 10 > 0, F.when(F.col("id") % 9 == 0, 2).otherwise(1)).alias("site_id"), F.when(F.col("id") % 11 > 0, F.col("id") * 0.045 - 15).alias("median_pixels_on_target"))
    before = _shuffled_records(spark)
    got = {r.id: r for r in tr.query_history(tracks, stored, now).collect()}
    assert _shuffled_records(spark) - before < 11 * 4000
    known = stored.collect()
    assert len(got) == 4000
    for r in got.values():
        px = r.median_pixels_on_target
        hits = sorted((s.ordinal, s.track_id) for s in known if r.site_id == 1 and px is not None and px - 8 <= s.median_pixels_on_target <= px + 8)
        assert (r.match_count, [m.track_id for m in r.matches]) == (len(hits), [t for _, t in hits[:10]])


def test_measures_are_rounded_in_code_that_is_compiled(spark, capsys):
    numbers = ["duration_seconds", "median_pixels_on_target", *tr._DECIMALS, "classifier_confidence", "interval_low", "interval_high"]
    tracks = spark.range(2000).select(
        F.col("id").alias("track_id"), F.lit(9).alias("n_observations"), (F.col("id") % 3 > 0).alias("classifier_trained"), F.lit("bird").alias("classifier_label"),
        *[F.when(F.col("id") % 13 != k, (F.col("id") * (2 * k + 1) - 900) / 800).alias(n) for k, n in enumerate(numbers)])
    out = tr.analyze_tracks(tracks)
    digits = {"duration_seconds": 2, "median_pixels_on_target": 1, **tr._DECIMALS, "classifier_confidence": 3, "interval_low": 3, "interval_high": 3}
    given = {r.track_id: r for r in tracks.collect()}
    for r in out.collect():
        g = given[r.track_id]
        assert [r[n] for n in digits] == [None if g[n] is None or (n[:2] in ("cl", "in") and not g.classifier_trained) else round(g[n], d) for n, d in digits.items()]
        assert r.hover_seconds == (None if g.hover_fraction is None or g.duration_seconds is None else round(g.hover_fraction * g.duration_seconds, 2))
    capsys.readouterr()
    out.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM interprets longer methods
