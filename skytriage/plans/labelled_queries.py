"""Labelled tracks, separation and the two-arm comparison."""

from pyspark.sql import functions as F

from skytriage.constants import FEATURES
from skytriage.functions.geometry import corners, pixels_on_target, size_bucket
from skytriage.functions.numeric import wilson
from skytriage.operators import separation as sp
from skytriage.operators.features import track_features
from skytriage.plans import sqlbits as s
from skytriage.plans.fixtures import ctes, table, view
from skytriage.plans.motion_queries import FEATURES_SQL, rounded_features, rounded_sql
from skytriage.plans.registry import query

_LABELLED = f"""{ctes('fx_observations')}, {FEATURES_SQL},
    who AS (SELECT DISTINCT track_id, label, source_clip FROM fx_observations),
    tracks AS (SELECT track_id, label, source_clip, {rounded_sql()} FROM features JOIN who USING (track_id))"""


def labelled(spark, sf):
    obs = view(spark, sf, "fx_observations")
    return rounded_features(track_features(obs, 30.0)[0]).join(
        obs.select("track_id", "label", "source_clip").distinct(), "track_id")


_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, label, {f} AS value FROM tracks" for f in FEATURES) + """),
    ranges AS (SELECT feature, label, count(*) AS n, min(value) AS low, list_sort(list(value))[count(*) // 2 + 1] AS median, max(value) AS high
               FROM long GROUP BY 1, 2)"""
_PAIRS = """pairs AS (SELECT a.feature, a.label AS label_a, b.label AS label_b FROM ranges a JOIN ranges b USING (feature)
             WHERE a.label < b.label AND NOT (a.low <= b.high AND b.low <= a.high))"""


@query("h2_label_census", ctes("fx_observations") + """
  SELECT label, count(DISTINCT track_id) AS n_tracks, count(DISTINCT source_clip) AS n_clips,
         greatest(50 - count(DISTINCT track_id), 0) AS shortfall, count(DISTINCT source_clip) < 3 AS few_clips
  FROM fx_observations GROUP BY label""")
def label_census(spark, sf):
    return sp.label_census(view(spark, sf, "fx_observations").select("track_id", "label", "source_clip").distinct())


@query("h3_feature_ranges", f"{_LABELLED}, {_LONG} SELECT * FROM ranges")
def ranges(spark, sf):
    return sp.feature_ranges(labelled(spark, sf))


# Clips hold few tracks each, so ranges per (clip, class) do come out disjoint.
_PER_CLIP = " UNION ALL ".join(f"SELECT '{f}@' || source_clip AS feature, label, {f} AS value FROM tracks" for f in FEATURES)


@query("h4_separated_pairs", f"""{_LABELLED},
    long AS ({_PER_CLIP}),
    ranges AS (SELECT feature, label, min(value) AS low, max(value) AS high FROM long GROUP BY 1, 2), {_PAIRS} SELECT * FROM pairs""")
def pairs(spark, sf):
    every = F.inline(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("value")) for f in FEATURES]))
    per_clip = labelled(spark, sf).select("source_clip", "label", every).groupBy(
        F.concat_ws("@", "name", F.col("source_clip").cast("string")).alias("feature"), "label").agg(
        F.min("value").alias("low"), F.max("value").alias("high"))
    return sp.separated_pairs(per_clip)


@query("h5_separation_summary", f"""{_LABELLED}, {_LONG}, {_PAIRS},
    c AS (SELECT label, count(*) AS n FROM tracks GROUP BY 1),
    e AS (SELECT coalesce(sum(2 * exp(lgamma(a.n + 1) + lgamma(b.n + 1) - lgamma(a.n + b.n + 1))), 0) * 9 AS expected
          FROM c a JOIN c b ON a.label < b.label)
  SELECT (SELECT count(DISTINCT feature) FROM pairs) AS found, round(expected, 9) AS expected,
         (SELECT count(DISTINCT feature) FROM pairs) <= expected AS at_or_below_chance FROM e""")
def chance(spark, sf):
    return sp.separate(labelled(spark, sf))[2].withColumn("expected", F.round("expected", 9))


@query("h6_hypothesis_buckets", f"""{_LABELLED}
  SELECT CASE WHEN median_pixels_on_target <= 20 THEN '<=20px' ELSE '>20px' END AS side, count(*) AS n_tracks FROM tracks GROUP BY 1""")
def sides(spark, sf):
    return sp.hypothesis_buckets(labelled(spark, sf))


_WILSON = """least(1, ({p} + 3.8414588206941254 / (2 * {n})) / (1 + 3.8414588206941254 / {n}) {sign} (1.959963984540054 / (1 + 3.8414588206941254 / {n})) * sqrt({p} * (1 - {p}) / {n} + 3.8414588206941254 / (4 * {n} * {n})))"""


def _interval(p, n):
    return (f"greatest(0, {_WILSON.format(p=p, n=n, sign='-')})", _WILSON.format(p=p, n=n, sign="+"))


@query("i5_wilson_interval", f"""
  SELECT l_suppkey, l_returnflag, count(*) FILTER (l_discount > 0.05) AS k, count(*) AS n,
         round({_interval("(count(*) FILTER (l_discount > 0.05) / count(*))", "count(*)")[0]}, 8) AS low,
         round({_interval("(count(*) FILTER (l_discount > 0.05) / count(*))", "count(*)")[1]}, 8) AS high
  FROM lineitem GROUP BY 1, 2""")
def wilson_rows(spark, sf):
    out = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("k"), F.count("*").alias("n"))
    ci = wilson(F.col("k"), F.col("n"))
    return out.select("l_suppkey", "l_returnflag", "k", "n", F.round(ci["low"], 8).alias("low"), F.round(ci["high"], 8).alias("high"))


_PREDS = ctes("fx_detections") + f""",
    preds AS (SELECT 'appearance' AS arm, {s.bucket(s.px('d'))} AS bucket, frame_index % 10 < 6 AS correct FROM fx_detections d
              UNION ALL SELECT 'motion', {s.bucket(s.px('d'))}, source_video % 10 < 8 FROM fx_detections d WHERE {s.px('d')} < 40),
    agg AS (SELECT arm, bucket, count(*) FILTER (correct) AS correct, count(*) AS total FROM preds GROUP BY 1, 2),
    scores AS (SELECT arm, bucket, correct, total, correct / total AS accuracy, {_interval('(correct / total)', 'total')[0]} AS low,
                      {_interval('(correct / total)', 'total')[1]} AS high, total < 30 AS thin FROM agg)"""


def _preds(spark, sf):
    px = pixels_on_target(corners())
    det = view(spark, sf, "fx_detections").select("source_video", "frame_index", px.alias("px"), size_bucket(px).alias("bucket"))
    a = det.select(F.lit("appearance").alias("arm"), "bucket", (F.col("frame_index") % 10 < 6).alias("correct"))
    m = det.where("px < 40").select(F.lit("motion").alias("arm"), "bucket", (F.col("source_video") % 10 < 8).alias("correct"))
    return a.unionByName(m)


@query("i6_bucket_scores", f"""{_PREDS}
  SELECT arm, bucket, correct, total, round(accuracy, 8) AS accuracy, round(low, 8) AS low, round(high, 8) AS high, thin FROM scores""")
def arm_scores(spark, sf):
    out = sp.bucket_scores(_preds(spark, sf))
    for c in ("accuracy", "low", "high"):
        out = out.withColumn(c, F.round(c, 8))
    return out


@query("i7_compare_arms", f"""{_PREDS},
    b AS (SELECT a.bucket, a.low AS al, a.high AS ah, a.total AS at_, m.low AS ml, m.high AS mh, m.total AS mt
          FROM scores a JOIN scores m USING (bucket) WHERE a.arm = 'appearance' AND m.arm = 'motion')
  SELECT CASE WHEN bool_or(bucket IN ('<8px', '8-16px') AND al > mh) THEN FALSE
              WHEN bool_or(bucket IN ('<8px', '8-16px') AND ml > ah) THEN TRUE END AS motion_wins,
         coalesce(string_agg(CASE WHEN at_ <> mt THEN bucket END, ',' ORDER BY bucket), '') AS unequal_buckets FROM b""")
def arms(spark, sf):
    return sp.compare_arms(sp.bucket_scores(_preds(spark, sf)))
