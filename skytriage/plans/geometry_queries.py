"""Geometry, tiling and detection post-processing (B, C)."""

from pyspark.sql import functions as F

from skytriage.functions import geometry as g
from skytriage.operators.matching import box_pairs
from skytriage.plans import sqlbits as s
from skytriage.plans.fixtures import ctes, view
from skytriage.plans.registry import query

_KEY = "source_video, frame_index, det_index"


@query("b1_b8_box_measures", ctes("fx_detections") + f"""
  SELECT {_KEY}, (x2 > x1 AND y2 > y1) AS valid, x1 AS w_x, x2 - x1 AS w_w, y2 - y1 AS w_h,
         (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, round(x1 / 1920, 9) AS n_x1, round(y2 / 1080, 9) AS n_y2,
         x1 + 64 AS f_x1, y2 - 32 AS t_y2,
         {s.area('d')} AS area, round({s.px('d')}, 6) AS px, {s.bucket(s.px('d'))} AS bucket
  FROM fx_detections d""")
def box_measures(spark, sf):
    b = g.corners()
    wh, c = g.xyxy_to_xywh(b), g.xyxy_to_cxcywh(b)
    n = g.normalise(b, 1920, 1080)
    back = g.xywh_to_xyxy(wh)
    shifted = g.tile_to_frame(back, F.lit(64), F.lit(0))
    local = g.frame_to_tile(g.cxcywh_to_xyxy(c), F.lit(0), F.lit(32))
    px = g.pixels_on_target(b)
    return view(spark, sf, "fx_detections").select(
        "source_video", "frame_index", "det_index", g.is_valid(b).alias("valid"),
        wh.a.alias("w_x"), wh.c.alias("w_w"), wh.d.alias("w_h"), c.a.alias("cx"), c.b.alias("cy"),
        F.round(n.a, 9).alias("n_x1"), F.round(n.d, 9).alias("n_y2"), shifted.a.alias("f_x1"), local.d.alias("t_y2"),
        g.area(b).alias("area"), F.round(px, 6).alias("px"), g.size_bucket(px).alias("bucket"))


@query("b9_iou_pairs", ctes("fx_detections", "fx_ground_truth") + f"""
  SELECT d.source_video, d.frame_index, d.det_index, g.gt_index, round({s.iou('d', 'g')}, 6) AS iou
  FROM fx_detections d JOIN fx_ground_truth g USING (source_video, frame_index)
  WHERE {s.iou('d', 'g')} >= 0.25""")
def iou_pairs(spark, sf):
    pairs = box_pairs(view(spark, sf, "fx_detections"), view(spark, sf, "fx_ground_truth"), 0.25)
    return pairs.select("source_video", "frame_index", "det_index", "gt_index", F.round("iou", 6).alias("iou"))
