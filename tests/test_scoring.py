"""Matching rules, AP hand values, and the crowded-frame path against the fold."""

import random

import pytest
from pyspark.sql import functions as F

from skytriage.operators.evaluation import average_precision, evaluate, sweep_ap
from skytriage.operators.matching import Cell, match_detections
from skytriage.operators.tiling import nms

DET = "source_video string, frame_index long, det_index long, x1 double, y1 double, x2 double, y2 double, score double"
GT = "source_video string, frame_index long, gt_index long, x1 double, y1 double, x2 double, y2 double"


def square(x, y, side):
    return (float(x), float(y), float(x + side), float(y + side))


def matched(spark, det, gt, cell, **kw):
    d = spark.createDataFrame([("v", 0, i, *b, s) for i, (b, s) in enumerate(det)], DET)
    g = spark.createDataFrame([("v", 0, i, *b) for i, b in enumerate(gt)], GT)
    return {r.det_index: r for r in match_detections(d, g, [cell], **kw).collect()}


@pytest.mark.parametrize("limit", [2000, 0])
def test_match_rules(spark, limit):
    kw = {"frame_limit": limit}
    # Higher score first, ties by row order, one ground truth each.
    r = matched(spark, [(square(0, 0, 10), 0.5), (square(0, 0, 10), 0.9), (square(0, 0, 10), 0.9)], [square(0, 0, 10)], Cell(0.5), **kw)
    assert [r[i].is_tp for i in range(3)] == [False, True, False]
    # Out of range: ignored, and it uses up the ground truth.
    r = matched(spark, [(square(0, 0, 64), 0.9), (square(0, 0, 64), 0.8)], [square(0, 0, 64)], Cell(0.5, "<8px"), **kw)
    assert r[0].is_ignored and not r[0].is_tp and not r[1].is_ignored and not r[1].is_tp
    # An eligible box is preferred over a better overlapping ineligible one.
    r = matched(spark, [(square(0, 0, 16), 0.9)], [(0.0, 0.0, 16.0, 16.0), (0.0, 0.0, 15.0, 16.0)], Cell(0.5, "8-16px"), **kw)
    assert r[0].is_tp and r[0].gt_index == 1
    # Equal overlap: the first ground truth.
    r = matched(spark, [(square(0, 0, 10), 0.9)], [square(1, 0, 10), square(-1, 0, 10)], Cell(0.5), **kw)
    assert r[0].gt_index == 0


@pytest.mark.parametrize("tp,ignored,scores,n,want", [
    ([1, 1], [0, 0], [0.9, 0.8], 2, 1.0), ([0, 0], [0, 0], [0.9, 0.8], 2, 0.0), ([1, 0], [0, 0], [0.9, 0.8], 2, 0.5),
    ([1, 0, 1], [0, 0, 0], [0.9, 0.8, 0.7], 2, 0.8333), ([0, 1], [0, 0], [0.9, 0.8], 2, 0.25), ([1, 1], [0, 0], [0.9, 0.8], 0, 0.0),
    ([1, 0], [0, 1], [0.9, 0.95], 1, 1.0)])
def test_ap_hand_values(spark, tp, ignored, scores, n, want):
    rows = [("c", "v", i, 0, bool(t), bool(g), s) for i, (t, g, s) in enumerate(zip(tp, ignored, scores))]
    m = spark.createDataFrame(rows, "cell string, source_video string, frame_index long, det_index long, is_tp boolean, is_ignored boolean, score double")
    e = spark.createDataFrame([("c", n)], "cell string, n_eligible long")
    assert average_precision(m, e, ["cell"]).first().average_precision == pytest.approx(want, abs=1e-4)


def scene(spark, seed, n_det=60, n_gt=25):
    rng = random.Random(seed)
    gt = [("v", f, i, *square(rng.uniform(0, 120), rng.uniform(0, 120), rng.choice([5, 10, 20, 40]))) for f in range(3) for i in range(n_gt)]
    det = []
    for f in range(3):
        for i in range(n_det):
            b = rng.choice([g for g in gt if g[1] == f])[3:]
            j = [v + rng.uniform(-2, 2) for v in b]
            det.append(("v", f, i, j[0], j[1], max(j[2], j[0] + 1), max(j[3], j[1] + 1), rng.choice([0.2, 0.5, 0.5, 0.8, 0.9])))
    return det, gt


def greedy(det, gt, thr, lo, hi):
    def iou(a, b):
        w, h = max(min(a[2], b[2]) - max(a[0], b[0]), 0), max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    out = {}
    for f in {d[1] for d in det}:
        free = {g[2]: g[3:7] for g in gt if g[1] == f}
        fits = {k: lo <= ((b[2] - b[0]) * (b[3] - b[1])) ** 0.5 < hi for k, b in free.items()}
        for d in sorted((d for d in det if d[1] == f), key=lambda d: (-d[7], d[2])):
            near = [(iou(d[3:7], b), -k) for k, b in free.items() if iou(d[3:7], b) >= thr]
            pool = [c for c in near if fits[-c[1]]] or near
            pick = max(pool, default=None)
            out[f, d[2]] = (None, False, False) if pick is None else (-pick[1], fits[-pick[1]], not fits[-pick[1]])
            if pick:
                del free[-pick[1]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_and_rounds_agree_with_brute_force(spark, seed):
    det, gt = scene(spark, seed)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)
    cells = [Cell(0.5), Cell(0.25, "8-16px")]
    for limit in (2000, 10):
        rows = match_detections(d, g, cells, frame_limit=limit).collect()
        for c in cells:
            want = greedy(det, gt, c.iou_threshold, *c.bounds)
            got = {(r.frame_index, r.det_index): (r.gt_index, r.is_tp, r.is_ignored) for r in rows if (r.iou_threshold, r.bucket) == (c.iou_threshold, c.bucket)}
            assert got == want


def test_nms_paths_agree(spark):
    det, _ = scene(spark, 7, n_det=80)
    d = spark.createDataFrame(det, DET)
    fold = sorted((r.frame_index, r.det_index) for r in nms(d, 0.4).collect())
    rounds = sorted((r.frame_index, r.det_index) for r in nms(d, 0.4, frame_limit=10).collect())
    assert fold == rounds and 0 < len(fold) < len(det)


def test_evaluate_passes_counts_between_blocks(spark):
    """Blocks and batches of a few rows, against a fold; no row is expanded per cell."""
    det, gt = scene(spark, 5)
    cells = [Cell(0.5), Cell(0.25, "8-16px"), Cell(0.75)]
    conf = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        d, g = spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)
        scored = evaluate(d, g, d.select("source_video", "frame_index").distinct(), cells, confidence=0.5)
        plan = scored._jdf.queryExecution().toString()
        rows = {(r.iou_threshold, r.bucket): r for r in scored.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for c in cells:
        kinds = greedy(det, gt, c.iou_threshold, *c.bounds)
        tp = ranked = kept_tp = kept_fp = 0
        precisions = []
        for x in sorted(det, key=lambda x: (-x[7], x[1], x[2])):
            _, is_tp, is_ignored = kinds[x[1], x[2]]
            tp, ranked = tp + is_tp, ranked + (not is_ignored)
            kept_tp, kept_fp = kept_tp + (is_tp and x[7] >= 0.5), kept_fp + (not is_tp and not is_ignored and x[7] >= 0.5)
            precisions += [tp / ranked] if is_tp else []
        row = rows[c.iou_threshold, c.bucket]
        assert (row.true_positives, row.false_positives) == (kept_tp, kept_fp)
        assert row.average_precision == pytest.approx(sum(max(precisions[i:]) for i in range(len(precisions))) / row.n_eligible, rel=1e-12)
    assert "posexplode" not in plan


def test_evaluate_counts_and_empty_split(spark):
    det, gt = scene(spark, 4)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)
    frames = d.select("source_video", "frame_index").distinct()
    row = evaluate(d, g, frames, [Cell(0.5)]).first()
    assert row.true_positives + row.false_positives == len(det) and row.true_positives + row.false_negatives == len(gt) == row.n_eligible
    with pytest.raises(Exception, match="no images"):
        evaluate(d.limit(0), g.limit(0), frames.limit(0), [Cell(0.5)]).collect()
    _, mean = sweep_ap(d, g, frames, thresholds=(0.5, 0.75))
    assert mean.first().mean_ap is None
    with pytest.raises(ValueError):
        Cell(0.0)


def test_nms_streams_whole_frames(spark):
    """Batches of a few rows, all columns kept, frames without a number, scores that tie or are missing, boxes without extent."""
    det, _ = scene(spark, 11, n_det=40)
    rows = [(*r[:-1], None if k % 17 == 0 else r[-1], k) for k, r in enumerate(det)]
    rows += [(rows[0][0], None, i, *map(float, b), 0.5, -1) for i, b in enumerate([(0, 0, 10, 10), (1, 0, 11, 10), (50, 50, 60, 60), (5, 5, 5, 5), (90, 90, 90, 90)])]
    d = spark.createDataFrame(rows, DET + ", tag long")

    def overlap(p, q):
        inter = max(min(p[2], q[2]) - max(p[0], q[0]), 0.0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0.0)
        union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - inter
        return inter / union if union else 0.0

    want, frames = set(), {}
    for r in rows:
        frames.setdefault(r[:2], []).append(r)
    for group in frames.values():
        kept = []
        for r in sorted(group, key=lambda r: (r[7] is not None, -(r[7] or 0.0), r[2])):
            if all(overlap(k[3:7], r[3:7]) < 0.4 for k in kept):
                kept.append(r)
        want |= set(kept)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in nms(d, 0.4).select(*d.columns).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == want and len(got) == len(want) < len(rows)


def test_merge_query_computes_the_view_once(spark):
    from skytriage.plans.tracking_queries import merged

    plan = merged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
