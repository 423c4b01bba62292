"""Splits, census, catalogue and false alarms (A18, A19, G, F7-F10)."""

from pyspark.sql import functions as F

from skytriage.operators import catalogue, census as cs, falsealarms as fa
from skytriage.operators.splits import grouped_split
from skytriage.plans import sqlbits as s
from skytriage.plans.fixtures import ctes, table, view
from skytriage.plans.registry import query

_GT = "SELECT *, CASE WHEN gt_index % 7 = 0 THEN NULL ELSE gt_index % 3 END AS track_id FROM fx_ground_truth"
_VIDEOS = ("SELECT s_suppkey AS source_video, CAST(24 + s_suppkey % 7 AS DOUBLE) AS fps, "
           "CASE s_suppkey % 3 WHEN 0 THEN 'annotated' WHEN 1 THEN 'single_target' ELSE 'none' END AS track_id_source FROM supplier")


def ground_truth(spark, sf):
    k = F.col("gt_index")
    return view(spark, sf, "fx_ground_truth").withColumn("track_id", F.when(k % 7 != 0, k % 3))


def videos(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("source_video"), (24 + k % 7).cast("double").alias("fps"),
        F.when(k % 3 == 0, "annotated").when(k % 3 == 1, "single_target").otherwise("none").alias("track_id_source"))


@query("g1_grouped_split", """
  WITH o AS (SELECT s_suppkey AS source_video, count(*) OVER () AS n,
                    row_number() OVER (ORDER BY substr(sha256('1337:' || CAST(s_suppkey AS VARCHAR)), 1, 16)) AS pos FROM supplier)
  SELECT source_video, CASE WHEN pos <= greatest(1, round_even(n * 0.7, 0)) THEN 'train'
         WHEN pos <= greatest(1, round_even(n * 0.7, 0)) + greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'test' END AS split FROM o""")
def split(spark, sf):
    return grouped_split(videos(spark, sf), 1337)


_CENSUS = ctes("fx_ground_truth", "fx_frames") + f", g AS ({_GT}), v AS ({_VIDEOS})"
_COUNTS_SQL = f"""
    counts AS (SELECT * FROM
      (SELECT count(*) AS n_videos, count(*) FILTER (track_id_source = 'annotated') AS ids_annotated,
              count(*) FILTER (track_id_source = 'single_target') AS ids_single_target,
              count(*) FILTER (track_id_source = 'none') AS ids_none FROM v),
      (SELECT count(*) AS n_frames FROM fx_frames),
      (SELECT count(*) AS n_empty_frames FROM fx_frames f ANTI JOIN g USING (source_video, frame_index)),
      (SELECT count(*) AS n_boxes, count(*) FILTER (label = 'drone') AS boxes_drone, count(*) FILTER (label = 'bird') AS boxes_bird,
              count(*) FILTER (label = 'aircraft') AS boxes_aircraft, count(*) FILTER (label = 'unknown') AS boxes_unknown,
              count(*) FILTER ({s.px('g')} < 8) AS "size_<8px", count(*) FILTER ({s.px('g')} >= 8 AND {s.px('g')} < 16) AS "size_8-16px",
              count(*) FILTER ({s.px('g')} >= 16 AND {s.px('g')} < 32) AS "size_16-32px", count(*) FILTER ({s.px('g')} >= 32) AS "size_>32px",
              count(*) FILTER (track_id IS NULL) AS n_untracked FROM g))"""
_TRACKS_SQL = f"""
    per_label AS (SELECT source_video, track_id, label, count(*) AS n, min(frame_index * 100000 + gt_index) AS seen
                  FROM g WHERE track_id IS NOT NULL GROUP BY ALL),
    major AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_video, track_id ORDER BY n DESC, seen) AS r,
                     count(*) OVER (PARTITION BY source_video, track_id) AS n_labels FROM per_label) WHERE r = 1),
    tracks AS (SELECT source_video, track_id, any_value(m.label) AS label, any_value(m.n_labels) AS n_labels,
                      count(*) AS n_observations, min(frame_index) AS first_frame, max(frame_index) AS last_frame,
                      round(quantile_cont({s.px('g')}, 0.5), 6) AS median_pixels_on_target,
                      max(frame_index) - min(frame_index) + 1 AS span
               FROM g JOIN major m USING (source_video, track_id) GROUP BY source_video, track_id)"""


@query("g2_census_counts", f"{_CENSUS}, {_COUNTS_SQL} SELECT * FROM counts")
def counts(spark, sf):
    return cs.census_counts(view(spark, sf, "fx_frames"), ground_truth(spark, sf), videos(spark, sf))


@query("g3_track_census", f"{_CENSUS}, {_TRACKS_SQL} SELECT * FROM tracks")
def tracks(spark, sf):
    return cs.track_census(ground_truth(spark, sf)).withColumn(
        "median_pixels_on_target", F.round("median_pixels_on_target", 6))


@query("g4_g5_census_warnings", f"""{_CENSUS}, {_COUNTS_SQL}, {_TRACKS_SQL},
    per AS (SELECT c.cls, count(t.label) AS n FROM (VALUES ('drone'), ('bird'), ('aircraft')) c(cls)
            LEFT JOIN tracks t ON t.label = c.cls GROUP BY c.cls)
  SELECT 'label_changes' AS code, source_video || '#' || track_id AS subject, n_labels AS count FROM tracks WHERE n_labels > 1
  UNION ALL SELECT 'untracked_boxes', NULL, n_untracked FROM counts WHERE n_untracked > 0
  UNION ALL SELECT 'zero_tracks', NULL, n_boxes FROM counts WHERE n_boxes > 0 AND (SELECT count(*) FROM tracks) = 0
  UNION ALL SELECT 'no_video_grouping', NULL, n_videos FROM counts WHERE n_videos > 1 AND n_videos = n_frames
  UNION ALL SELECT 'inferred_ids', NULL, ids_single_target FROM counts WHERE ids_single_target > 0
  UNION ALL SELECT 'few_tracks', cls, n FROM per WHERE n < 50
  UNION ALL SELECT 'no_discrimination_signal', CASE WHEN boxes_drone > 0 THEN 'drone' WHEN boxes_bird > 0 THEN 'bird' ELSE 'aircraft' END, n_empty_frames
            FROM counts WHERE (boxes_drone > 0)::INT + (boxes_bird > 0)::INT + (boxes_aircraft > 0)::INT = 1 AND n_empty_frames / n_frames < 0.02""")
def warnings(spark, sf):
    return cs.census(view(spark, sf, "fx_frames"), ground_truth(spark, sf), videos(spark, sf))[2]


@query("g6_frame_structure", ctes("fx_frames") + """
  SELECT source_video, count(*) AS n_frames, count(DISTINCT frame_index) = count(*) AS unique_frames FROM fx_frames GROUP BY 1""")
def structure(spark, sf):
    return cs.frame_structure(view(spark, sf, "fx_frames"))


@query("a19_media_limits_gate", """
  SELECT p_partkey AS source_video, CASE
    WHEN p_size * 100 - 100 <= 0 OR p_size * 60 <= 0 THEN 'invalid dimensions'
    WHEN p_partkey % 130 <= 0 THEN 'invalid frame rate' WHEN p_retailprice - 950 <= 0 THEN 'invalid duration'
    WHEN p_size * 100 - 100 > 4096 OR p_size * 60 > 4096 THEN 'resolution'
    WHEN p_partkey % 130 > 120 THEN 'frame rate' WHEN p_retailprice - 950 > 300 THEN 'duration'
    WHEN CAST(p_size * 100 - 100 AS DOUBLE) * (p_size * 60) * (p_partkey % 130) * (p_retailprice - 950) > 4e10 THEN 'total pixels'
    ELSE 'accepted' END AS violation FROM part""")
def gate(spark, sf):
    vids = table(spark, sf, "part").select(
        F.col("p_partkey").alias("source_video"), (F.col("p_size") * 100 - 100).alias("width"), (F.col("p_size") * 60).alias("height"),
        (F.col("p_partkey") % 130).cast("double").alias("fps"), (F.col("p_retailprice") - 950).alias("duration_seconds"))
    ok, bad = catalogue.media_limits_gate(vids)
    return ok.select("source_video", F.lit("accepted").alias("violation")).unionByName(bad.select("source_video", "violation"))


# Every (video, frame) becomes one still, so that there is something to sample from.
_STILLS = ctes("fx_ground_truth", "fx_frames") + f""",
    fr AS (SELECT source_video * 1000 + frame_index AS still FROM fx_frames),
    g AS (SELECT source_video * 1000 + frame_index AS still, {s.px('g')} AS px FROM fx_ground_truth g),
    med AS (SELECT still, count(*) AS n_boxes, quantile_cont(px, 0.5) AS m FROM g GROUP BY still),
    listed AS (SELECT fr.still, coalesce(n_boxes, 0) AS n_boxes, m, row_number() OVER (ORDER BY fr.still) - 1 AS place
               FROM fr LEFT JOIN med USING (still)),
    sized AS (SELECT *, row_number() OVER (ORDER BY m, place) - 1 AS r, count(*) OVER () AS n FROM listed WHERE n_boxes > 0),
    fixed AS (SELECT still, place, 0 AS p, 'smallest box' AS reason FROM sized WHERE r = 0
      UNION ALL SELECT still, place, 1, 'median box' FROM sized WHERE r = n // 2
      UNION ALL SELECT still, place, 2, 'largest box' FROM sized WHERE r = n - 1
      UNION ALL (SELECT still, place, 3, 'several objects' FROM listed WHERE n_boxes > 1 ORDER BY place LIMIT 1)
      UNION ALL (SELECT still, place, 4, 'no objects' FROM listed WHERE n_boxes = 0 ORDER BY place LIMIT 1)),
    chosen AS (SELECT still, any_value(place) AS place, min(p) AS p, arg_min(reason, p) AS reason FROM fixed GROUP BY still),
    step AS (SELECT greatest(1, (SELECT count(*) FROM listed) // (12 - count(*) + 1)) AS st, 12 - count(*) AS rest FROM chosen),
    fill AS (SELECT still, 5 + place AS p, 'even stride' AS reason,
                    row_number() OVER (ORDER BY place) AS k FROM listed, step
             WHERE place % st = 0 AND still NOT IN (SELECT still FROM chosen))
  SELECT still AS source_video, reason FROM chosen
  UNION ALL SELECT still, reason FROM fill, step WHERE k <= rest"""


@query("a18_sample_frames", _STILLS)
def samples(spark, sf):
    still = (F.col("source_video") * 1000 + F.col("frame_index")).alias("source_video")
    fr = view(spark, sf, "fx_frames").select(still, F.lit(0).alias("frame_index"))
    gt = view(spark, sf, "fx_ground_truth").select(still, "x1", "y1", "x2", "y2")
    return catalogue.sample_frames(fr, gt, 12)


_ALARM = ctes("fx_detections", "fx_frames") + f""", v AS ({_VIDEOS}),
    clip AS (SELECT source_video, count(*) AS n_frames, count(*) / any_value(fps) AS secs FROM fx_frames JOIN v USING (source_video) GROUP BY 1),
    fired AS (SELECT * FROM fx_detections WHERE score >= 0.5)"""


def _garwood(src: str) -> str:
    """Bisection on the Poisson tail: the bounds where the tail holds 2.5 % of the mass."""
    tail = "(SELECT sum(exp(k * ln({lam}) - {lam} - lgamma(k + 1))) FROM (SELECT unnest(range(0, CAST({top} AS BIGINT))) AS k))"
    return f"""
    distinct_n AS (SELECT DISTINCT n_false_alarms AS n FROM {src}),
    bis AS (
      SELECT n, 0 AS i, 0.0::DOUBLE AS l0, n + 10.0 * sqrt(n + 1) + 20.0 AS l1, 0.0::DOUBLE AS h0, n + 10.0 * sqrt(n + 1) + 20.0 AS h1 FROM distinct_n
      UNION ALL
      SELECT n, i + 1, CASE WHEN {tail.format(lam='((l0 + l1) / 2)', top='n')} > 0.975 THEN (l0 + l1) / 2 ELSE l0 END,
                       CASE WHEN {tail.format(lam='((l0 + l1) / 2)', top='n')} > 0.975 THEN l1 ELSE (l0 + l1) / 2 END,
                       CASE WHEN {tail.format(lam='((h0 + h1) / 2)', top='n + 1')} > 0.025 THEN (h0 + h1) / 2 ELSE h0 END,
                       CASE WHEN {tail.format(lam='((h0 + h1) / 2)', top='n + 1')} > 0.025 THEN h1 ELSE (h0 + h1) / 2 END
      FROM bis WHERE i < 50),
    garwood AS (SELECT n, CASE WHEN n = 0 THEN 0 ELSE (l0 + l1) / 2 END AS low, (h0 + h1) / 2 AS high FROM bis WHERE i = 50)"""


_RATE_COLS = ("duration_hours", "effective_fps", "per_hour", "per_frame", "low_per_hour", "high_per_hour")


def _rates(df, digits=5):
    for c in _RATE_COLS:
        if c in df.columns:
            df = df.withColumn(c, F.round(c, digits))
    return df


@query("f7_f9_false_alarm_rate_per_clip", f"""{_ALARM},
    per AS (SELECT c.source_video, count(f.score) AS n_false_alarms, any_value(c.n_frames) AS n_frames, any_value(secs) / 3600 AS h
            FROM clip c LEFT JOIN fired f USING (source_video) GROUP BY 1), {_garwood('per')}
  SELECT source_video, n_false_alarms, n_frames, round(h, 5) AS duration_hours, round(n_frames / (h * 3600), 5) AS effective_fps,
         0.5::DOUBLE AS confidence_threshold, round(n_false_alarms / h, 5) AS per_hour, round(n_false_alarms / n_frames, 5) AS per_frame,
         round(low / h, 3) AS low_per_hour, round(high / h, 3) AS high_per_hour, h < 0.5 AS not_enough_footage
  FROM per JOIN garwood ON n = n_false_alarms""")
def rate_per_clip(spark, sf):
    out = fa.alarm_rate(view(spark, sf, "fx_detections"), view(spark, sf, "fx_frames"),
                        videos(spark, sf).select("source_video", "fps"), 0.5, keys=["source_video"])
    return _rates(out).withColumn("low_per_hour", F.round("low_per_hour", 3)).withColumn("high_per_hour", F.round("high_per_hour", 3))


@query("f7_f8_false_alarm_rate_total", f"""{_ALARM}
  SELECT (SELECT count(*) FROM fired) AS n_false_alarms, CAST(sum(n_frames) AS BIGINT) AS n_frames, round(sum(secs) / 3600, 5) AS duration_hours,
         round(sum(n_frames) / sum(secs), 5) AS effective_fps,
         round((SELECT count(*) FROM fired) / (sum(secs) / 3600), 5) AS per_hour,
         round((SELECT count(*) FROM fired) / sum(n_frames), 5) AS per_frame, sum(secs) / 3600 < 0.5 AS not_enough_footage FROM clip""")
def rate_total(spark, sf):
    out = fa.alarm_rate(view(spark, sf, "fx_detections"), view(spark, sf, "fx_frames"), videos(spark, sf).select("source_video", "fps"), 0.5)
    return _rates(out).drop("low_per_hour", "high_per_hour", "confidence_threshold")


@query("f10_false_alarm_profile", f"""{_ALARM},
    b(bucket) AS (VALUES ('<8px'), ('8-16px'), ('16-32px'), ('>32px')),
    s(band, lo, hi) AS (VALUES ('0.00-0.25', 0, 0.25), ('0.25-0.50', 0.25, 0.5), ('0.50-0.70', 0.5, 0.7), ('0.70-0.80', 0.7, 0.8), ('0.80-0.90', 0.8, 0.9), ('0.90-1.00', 0.9, 1.01))
  SELECT 'bucket' AS part, b.bucket AS name, (SELECT count(*) FROM fired f WHERE {s.bucket(s.px('f'))} = b.bucket) + 0.0::DOUBLE AS n FROM b
  UNION ALL SELECT 'band', band, (SELECT count(*) FROM fired f WHERE f.score >= s.lo AND f.score < s.hi) + 0.0::DOUBLE FROM s
  UNION ALL SELECT 'stat', 'max_score', max(score) FROM fired UNION ALL SELECT 'stat', 'median_score', quantile_cont(score, 0.5) FROM fired
  UNION ALL SELECT 'stat', 'mostly_large', CASE WHEN count(*) FILTER ({s.px('f')} >= 32) >= greatest(1, count(*) // 2) THEN 1 ELSE 0 END FROM fired f""")
def profile(spark, sf):
    by_bucket, by_band, stats = fa.alarm_profile(view(spark, sf, "fx_detections"), 0.5)
    n = F.col("n").cast("double").alias("n")
    flat = stats.select("max_score", "median_score", F.col("mostly_large").cast("double").alias("mostly_large"))
    return (by_bucket.select(F.lit("bucket").alias("part"), F.col("bucket").alias("name"), n)
            .unionByName(by_band.select(F.lit("band").alias("part"), F.col("band").alias("name"), n))
            .unionByName(flat.unpivot([], ["max_score", "median_score", "mostly_large"], "name", "n").withColumn("part", F.lit("stat"))))
