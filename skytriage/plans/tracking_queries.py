"""Tiles, suppression, links and tracks (C, D1-D3)."""

from pyspark.sql import functions as F

from skytriage.functions.geometry import affinity, corners, field_box
from skytriage.operators import linking, tiling
from skytriage.operators.tracking import track_videos
from skytriage.plans import sqlbits as s
from skytriage.plans.dataset_queries import videos
from skytriage.plans.fixtures import ctes, table, view
from skytriage.plans.registry import query


def _sizes(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(p.alias("source_video"), (320 + p % 37 * 100).cast("int").alias("frame_width"), (240 + p % 23 * 90).cast("int").alias("frame_height"))


_TILES = """
    v AS (SELECT p_partkey AS source_video, CAST(320 + p_partkey % 37 * 100 AS INT) AS fw, CAST(240 + p_partkey % 23 * 90 AS INT) AS fh FROM part),
    c AS (SELECT *, least(640, fw) AS tw, least(480, fh) AS th FROM v),
    st AS (SELECT *, greatest(1, CAST(round_even(tw * 0.8, 0) AS INT)) AS sx, greatest(1, CAST(round_even(th * 0.8, 0) AS INT)) AS sy FROM c),
    o AS (SELECT source_video, tw, th, list_sort(list_distinct(list_append(range(0, fw - tw + 1, sx), fw - tw))) AS xs,
                 list_sort(list_distinct(list_append(range(0, fh - th + 1, sy), fh - th))) AS ys FROM st),
    tiles AS (SELECT source_video, tw AS tile_w, th AS tile_h, len(xs) AS nx, xs, unnest(ys) AS offset_y, unnest(range(0, len(ys))) AS r FROM o),
    tiled AS (SELECT source_video, tile_w, tile_h, offset_y, r, nx, unnest(xs) AS offset_x, unnest(range(0, nx)) AS k FROM tiles)"""


@query("c1_generate_tiles", f"""WITH {_TILES}
  SELECT source_video, CAST(r * nx + k AS INT) AS tile_index, CAST(offset_x AS INT) AS offset_x, CAST(offset_y AS INT) AS offset_y, tile_w, tile_h FROM tiled""")
def tiles(spark, sf):
    return tiling.generate_tiles(_sizes(spark, sf), 640, 480, 0.2)


def _greedy_nms(src: str, thr: float) -> str:
    """Recursion over the boxes of a frame in score order, carrying those kept so far."""
    return f"""
    q AS (SELECT *, row_number() OVER (PARTITION BY source_video, frame_index ORDER BY score DESC, det_index) AS turn FROM {src}),
    fold AS (
      SELECT source_video, frame_index, CAST(0 AS BIGINT) AS turn, CAST([] AS STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept, FALSE AS ok, CAST(NULL AS BIGINT) AS det_index
      FROM (SELECT DISTINCT source_video, frame_index FROM q)
      UNION ALL
      SELECT source_video, frame_index, turn, CASE WHEN ok THEN list_append(kept, b) ELSE kept END, ok, det_index FROM (
        SELECT q.source_video, q.frame_index, q.turn, q.det_index, f.kept, {{'x1': q.x1, 'y1': q.y1, 'x2': q.x2, 'y2': q.y2}} AS b,
               len(list_filter(f.kept, lambda k: {s.iou('k', 'q')} >= {thr})) = 0 AS ok
        FROM fold f JOIN q ON q.source_video = f.source_video AND q.frame_index = f.frame_index AND q.turn = f.turn + 1))"""


_PER_TILE = ctes("fx_detections") + """,
    moved AS (SELECT source_video, frame_index, det_index * 2 AS det_index, x1, y1, x2, y2, score FROM fx_detections
              UNION ALL SELECT source_video, frame_index, det_index * 2 + 1, x1 + 2, y1, x2 + 2, y2, score * 0.5 FROM fx_detections)"""


@query("c2_c3_merge_tiles_nms", f"""{_PER_TILE}, {_greedy_nms('moved', 0.5)}
  SELECT m.source_video, m.frame_index, m.det_index, m.x1, m.y1, m.score FROM moved m JOIN fold f USING (source_video, frame_index, det_index) WHERE f.ok""")
def merged(spark, sf):
    d = view(spark, sf, "fx_detections")
    # The same scene seen through two tiles whose origins differ; the second view is
    # displaced by two pixels and less certain.
    k = F.col("det_index")
    # Only the number of the tile is exploded, so the view is read once and a count does not compute the rest.
    again = F.col("tile_index") == 1
    both = d.withColumn("tile_index", F.explode_outer(F.array(F.lit(0), F.lit(1)))).withColumns({
        "det_index": k * 2 + F.col("tile_index"), "x1": F.when(again, F.col("x1") + 2 - 640).otherwise(F.col("x1")),
        "x2": F.when(again, F.col("x2") + 2 - 640).otherwise(F.col("x2")), "score": F.when(again, F.col("score") * 0.5).otherwise(F.col("score"))})
    origin = videos(spark, sf).select("source_video", F.inline(F.array(
        *[F.struct(F.lit(t).alias("tile_index"), F.lit(x).alias("offset_x"), F.lit(0).alias("offset_y")) for t, x in ((0, 0), (1, 640))])))
    return tiling.merge_tiles(both, origin, 0.5).select("source_video", "frame_index", "det_index", "x1", "y1", "score")


_FLAT = "SELECT source_video, frame_index, det_index, x1, y1, CASE WHEN det_index % 5 = 0 THEN x1 ELSE x2 END AS x2, y2, score FROM {fx}"


@query("c4_c5_degenerate_confidence", ctes("fx_detections") + f""", d AS ({_FLAT.format(fx='fx_detections')})
  SELECT count(*) AS n_detections, count(*) FILTER (x2 <= x1) AS n_dropped, max(score) FILTER (x2 <= x1) AS max_dropped_score,
         max(score) FILTER (x2 <= x1) >= 0.25 AS affects_operating_point, count(*) FILTER (x2 > x1 AND score >= 0.25) AS n_kept_at_threshold FROM d""")
def degenerate(spark, sf):
    d = spark.sql(_FLAT, fx=view(spark, sf, "fx_detections"))
    kept, stats = tiling.drop_degenerate(d, 0.25)
    n = tiling.filter_confidence(kept, 0.25).agg(F.count("*").alias("n_kept_at_threshold")).withColumn("_one", F.lit(1))
    return stats.withColumn("_one", F.lit(1)).join(n, "_one").drop("_one")


@query("c6_detection_funnel", ctes("fx_detections") + """
  SELECT s.s_suppkey AS source_video, count(d.score) AS n_detections, count(d.score) FILTER (d.score >= 0.5) AS n_high, count(d.score) FILTER (d.score >= 0.1) AS n_low,
         max(d.score) AS best_score, CASE WHEN s.s_suppkey % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS n_tracks, count(d.score) > 0 AND s.s_suppkey % 4 = 0 AS no_tracks_from_detections
  FROM supplier s LEFT JOIN fx_detections d ON d.source_video = s.s_suppkey GROUP BY s.s_suppkey""")
def funnel(spark, sf):
    tracks = videos(spark, sf).where("source_video % 4 <> 0").select("source_video")
    return tiling.detection_funnel(view(spark, sf, "fx_detections"), tracks, videos(spark, sf))


def _affinity_sql(a: str, b: str) -> str:
    dist = f"sqrt((({a}.x1 + {a}.x2) / 2 - ({b}.x1 + {b}.x2) / 2)**2 + (({a}.y1 + {a}.y2) / 2 - ({b}.y1 + {b}.y2) / 2)**2)"
    near = f"greatest(least(1 - {dist} / (2.0 * greatest({s.px(a)}, 1e-6)), 1), 0) * 0.3 * 0.999"
    return f"greatest(CASE WHEN {s.iou(a, b)} >= 0.3 THEN {s.iou(a, b)} ELSE 0 END, {near})"


_CAND = ctes("fx_detections") + f""",
    cand AS (SELECT a.source_video, a.frame_index AS a_frame, a.det_index AS a_det, b.frame_index AS b_frame, b.det_index AS b_det,
                    b.frame_index - a.frame_index AS gap, {_affinity_sql('a', 'b')} AS aff
             FROM (SELECT *, unnest([1, 2]) AS ahead FROM fx_detections) a JOIN fx_detections b ON a.source_video = b.source_video AND b.frame_index = a.frame_index + a.ahead),
    ok AS (SELECT * FROM cand WHERE aff > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY source_video, a_frame, a_det ORDER BY aff DESC, gap, b_det) AS f,
                    row_number() OVER (PARTITION BY source_video, b_frame, b_det ORDER BY aff DESC, gap, a_det) AS g FROM ok),
    link AS (SELECT * FROM best WHERE f = 1 AND g = 1)"""


@query("d1_affinity", f"{_CAND} SELECT source_video, a_frame, a_det, b_frame, b_det, round(aff, 6) AS affinity FROM ok")
def affinities(spark, sf):
    c = linking.link_candidates(view(spark, sf, "fx_detections"), 2, 0.3, 2.0)
    return c.select("source_video", "a_frame", "a_det", "b_frame", "b_det", F.round("affinity", 6).alias("affinity"))


@query("d1_affinity_totals", f"""{_CAND} SELECT source_video, CAST(gap AS INT) AS gap, count(*) AS n_pairs, CAST(sum(CAST(round(aff * 1000000) AS BIGINT)) AS BIGINT) AS millionths,
         max(round(aff, 6)) AS strongest, count(*) FILTER (aff >= 0.3) AS n_overlapping FROM ok GROUP BY 1, 2""")
def affinity_totals(spark, sf):
    c = linking.link_candidates(view(spark, sf, "fx_detections"), 2, 0.3, 2.0)
    return c.groupBy("source_video", "gap").agg(F.count("*").alias("n_pairs"), F.sum(F.round(F.col("affinity") * 1000000).cast("bigint")).alias("millionths"),
                                                F.max(F.round("affinity", 6)).alias("strongest"), F.count_if(F.col("affinity") >= 0.3).alias("n_overlapping"))


@query("d2_link_detections", f"""{_CAND},
    chain AS (SELECT d.source_video, d.frame_index, d.det_index, d.frame_index AS root_frame, d.det_index AS root_det FROM fx_detections d
              WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.source_video = d.source_video AND l.b_frame = d.frame_index AND l.b_det = d.det_index)
              UNION ALL SELECT c.source_video, l.b_frame, l.b_det, c.root_frame, c.root_det FROM chain c JOIN link l
                ON l.source_video = c.source_video AND l.a_frame = c.frame_index AND l.a_det = c.det_index)
  SELECT * FROM chain""")
def linked(spark, sf):
    out = linking.link_detections(view(spark, sf, "fx_detections"), max_gap=2)
    return out.select("source_video", "frame_index", "det_index", "root_frame", "root_det")


@query("c6_funnel_of_linked_tracks", f"""{_CAND},
    t AS (SELECT d.source_video, count(*) AS n_tracks FROM fx_detections d
          WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.source_video = d.source_video AND l.b_frame = d.frame_index AND l.b_det = d.det_index) GROUP BY 1)
  SELECT s.s_suppkey AS source_video, count(d.score) AS n_detections, count(d.score) FILTER (d.score >= 0.7) AS n_high, count(d.score) FILTER (d.score >= 0.2) AS n_low,
         max(d.score) AS best_score, coalesce(any_value(t.n_tracks), 0) AS n_tracks, count(d.score) > 0 AND coalesce(any_value(t.n_tracks), 0) = 0 AS no_tracks_from_detections
  FROM supplier s LEFT JOIN fx_detections d ON d.source_video = s.s_suppkey LEFT JOIN t ON t.source_video = s.s_suppkey GROUP BY s.s_suppkey""")
def funnel_of_tracks(spark, sf):
    """The funnel down to the tracklets that linking makes of the same detections."""
    det = view(spark, sf, "fx_detections")
    tracks = linking.link_detections(det, max_gap=2).select("source_video", "root_frame", "root_det").distinct()
    return tiling.detection_funnel(det, tracks, videos(spark, sf), high=0.7, low=0.2)


@query("d3_d4_track_videos")
def tracked(spark, sf):
    return track_videos(view(spark, sf, "fx_detections"), view(spark, sf, "fx_frames"), include_expired=True)
