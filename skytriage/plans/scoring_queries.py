"""Detection evaluation."""

from pyspark.sql import functions as F

from skytriage.constants import AP_SWEEP, BUCKETS
from skytriage.operators.evaluation import evaluate, report_cells, run_totals, score_report, sweep_ap
from skytriage.operators.matching import Cell, match_detections
from skytriage.plans import sqlbits as s
from skytriage.plans.fixtures import ctes, view
from skytriage.plans.registry import query

_BOUNDS = {"all": (0.0, "inf")} | {n: (lo, "inf" if hi == float("inf") else hi) for n, lo, hi in BUCKETS}


def _sql_cells(cells):
    return [(c.bucket, c.iou_threshold, *_BOUNDS[c.bucket]) for c in cells]


def _inputs(spark, sf):
    return [view(spark, sf, n) for n in ("fx_detections", "fx_ground_truth", "fx_frames")]


_VIEWS = ctes("fx_detections", "fx_ground_truth")
_MATCH_CELLS = [Cell(0.5), Cell(0.5, "8-16px"), Cell(0.25, "<8px"), Cell(0.5, ">32px")]


@query("f1_f2_match_detections", _VIEWS + "," + s.greedy_cells(_sql_cells(_MATCH_CELLS)) + """
  SELECT thr AS iou_threshold, bucket, source_video, frame_index, det_index, score,
         kind = 1 AS is_tp, kind = 2 AS is_ignored, gt_index FROM outcome""")
def matches(spark, sf):
    det, gt, _ = _inputs(spark, sf)
    return match_detections(det, gt, _MATCH_CELLS)


_COUNTS = """
      SELECT e.cell, coalesce(sum(CASE WHEN o.kind = 1 {conf} THEN 1 ELSE 0 END), 0) AS tp,
             coalesce(sum(CASE WHEN o.kind = 0 {conf} THEN 1 ELSE 0 END), 0) AS fp, any_value(e.n_eligible) AS n_eligible
      FROM eligible e LEFT JOIN outcome o ON o.cell = e.cell GROUP BY e.cell"""

_CELL_ROW = """
  SELECT {lead} c.thr AS iou_threshold, c.bucket, CAST(n.tp AS BIGINT) AS true_positives, CAST(n.fp AS BIGINT) AS false_positives,
         CAST(n.n_eligible - n.tp AS BIGINT) AS false_negatives, n.n_eligible,
         round(CASE WHEN n.n_eligible > 0 THEN coalesce(ap.area, 0) / n.n_eligible ELSE 0 END, 6) AS average_precision,
         round(CASE WHEN n.tp + n.fp > 0 THEN n.tp / (n.tp + n.fp) ELSE 0 END, 6) AS precision,
         round(CASE WHEN n.n_eligible > 0 THEN n.tp / n.n_eligible ELSE 0 END, 6) AS recall {tail}
  FROM {src} n JOIN cells c USING (cell) LEFT JOIN ap USING (cell)"""


def _rounded(df):
    for c in ("average_precision", "precision", "recall"):
        df = df.withColumn(c, F.round(c, 6))
    return df


_EVAL_CELLS = [Cell(0.5), Cell(0.75), Cell(0.5, "8-16px"), Cell(0.5, "16-32px")]


@query("f3_f4_evaluate_dataset", _VIEWS + "," + s.greedy_cells(_sql_cells(_EVAL_CELLS)) + "," + s.ELIGIBLE + "," + s.AP
       + f", counts AS ({_COUNTS.format(conf='')})" + _CELL_ROW.format(lead="", tail="", src="counts"))
def evaluated(spark, sf):
    return _rounded(evaluate(*_inputs(spark, sf), _EVAL_CELLS)).drop("cell")


_SWEEP = [Cell(t) for t in AP_SWEEP]


@query("f5_sweep_ap", _VIEWS + "," + s.greedy_cells(_sql_cells(_SWEEP)) + "," + s.ELIGIBLE + "," + s.AP + """
  SELECT 'all' AS bucket, round(avg(coalesce(ap.area, 0) / e.n_eligible), 6) AS mean_ap
  FROM eligible e LEFT JOIN ap USING (cell)""")
def swept(spark, sf):
    _, mean = sweep_ap(*_inputs(spark, sf))
    return mean.withColumn("mean_ap", F.round("mean_ap", 6))


_LISTED = report_cells()
_REPORT = list(dict.fromkeys(c for _, c in _LISTED))
_SECTIONS = ", ".join(f"('{sec}', {_REPORT.index(c)})" for sec, c in _LISTED)


@query("f6_score_report", _VIEWS + "," + s.greedy_cells(_sql_cells(_REPORT)) + "," + s.ELIGIBLE + "," + s.AP
       + f""", counts AS ({_COUNTS.format(conf='')}),
       op AS ({_COUNTS.format(conf='AND o.score >= 0.25')}),
       sections(section, cell) AS (VALUES {_SECTIONS})"""
       + _CELL_ROW.format(lead="x.section,", tail=", n.n_eligible < 30 AS thin", src="sections x JOIN counts") .replace(
           "sections x JOIN counts n JOIN cells c USING (cell)",
           "sections x JOIN counts n USING (cell) JOIN cells c USING (cell)")
       + " UNION ALL "
       + _CELL_ROW.format(lead="'operating_point' AS section,", tail=", n.n_eligible < 30 AS thin", src="op")
       + f" WHERE c.cell = {_REPORT.index(Cell(0.5))}")
def report(spark, sf):
    return _rounded(score_report(*_inputs(spark, sf)))


@query("f11_run_totals", ctes("fx_detections", "fx_frames") + """
  SELECT (SELECT count(*) FROM fx_frames) AS n_images, (SELECT count(*) FROM fx_detections) AS n_detections,
         round((SELECT count(*) FROM fx_frames) / 2.5, 6) AS images_per_second""")
def totals(spark, sf):
    det, _, frames = _inputs(spark, sf)
    return run_totals(frames, det, 2.5).withColumn("images_per_second", F.round("images_per_second", 6))
