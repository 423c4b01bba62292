"""Greedy matching of detections to ground truth, and pairs by overlap.

Detections are taken by falling score; each takes the best overlapping box that is still
free, preferring boxes inside the size range of the evaluation cell. Several cells
(IoU threshold x size range) are settled in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skytriage.constants import BUCKETS
from skytriage.functions.geometry import corners, field_box, iou, pixels_on_target
from skytriage.operators.frames import FRAME, changes, whole_frames
from skytriage.operators.grid import home_cell, probe_cells
from skytriage.operators.scan import split_by_size
from skytriage.session import durable

#: A frame with more rows than this (detections and ground truth together) is settled by
#: distributed rounds instead of one fold, so that no task holds an unbounded frame.
FRAME_LIMIT = 2_000

#: Ground-truth boxes of a frame up to which every detection of the frame may meet them.
CROWD = 64

FALSE_POSITIVE, TRUE_POSITIVE, IGNORED = 0, 1, 2


@dataclass(frozen=True)
class Cell:
    """One evaluation: an IoU threshold and a half-open size range in pixels."""

    iou_threshold: float
    bucket: str = "all"

    def __post_init__(self) -> None:
        if not 0.0 < self.iou_threshold <= 1.0:
            raise ValueError(f"iou_threshold must be in (0, 1]; got {self.iou_threshold}")

    @property
    def bounds(self) -> tuple[float, float]:
        return {name: (lo, hi) for name, lo, hi in BUCKETS}.get(self.bucket, (0.0, float("inf")))


def cell_array(cells: list[Cell]) -> Column:
    """The evaluation cells as one array literal, so a plan has one fold however many there are."""
    return F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(c.iou_threshold).alias("thr"),
                              F.lit(c.bounds[0]).alias("lo"), F.lit(c.bounds[1]).alias("hi"),
                              F.lit(c.bucket).alias("bucket")) for i, c in enumerate(cells)])


def box_pairs(det: DataFrame, gt: DataFrame, min_iou: float, crowd: int = CROWD) -> DataFrame:
    """Overlapping (detection, ground truth) pairs of the same frame with IoU >= ``min_iou``.

    Frames with few ground-truth boxes meet on the frame number. In crowded ones the
    boxes are filed under grid cells, so a frame neither meets on one key nor produces
    its full cross product; each pair appears once, since a detection has one home cell.
    """
    left = det.select(*FRAME, "det_index", "score", F.struct("x1", "y1", "x2", "y2").alias("d"))
    small, large = split_by_size(gt.select(*FRAME, "gt_index", "x1", "y1", "x2", "y2"), FRAME, crowd)
    box = F.struct("x1", "y1", "x2", "y2").alias("g")
    cols = [*FRAME, "det_index", "gt_index", "score", "d", "g"]
    pairs = left.join(small.select(*FRAME, "gt_index", box), FRAME).select(*cols)
    if large is not None:
        filed = left.withColumn("cell", home_cell(field_box(F.col("d"))))
        probing = large.select(*FRAME, "gt_index", box, F.explode_outer(probe_cells(corners(), min_iou)).alias("cell"))
        pairs = pairs.unionByName(filed.join(probing, [*FRAME, "cell"]).select(*cols))
    return (
        pairs.withColumn("iou", iou(field_box(F.col("d")), field_box(F.col("g")))).where(F.col("iou") >= min_iou)
        .select(*FRAME, "det_index", "gt_index", "score", "iou", pixels_on_target(field_box(F.col("g"))).alias("gt_px")))


def _settled(t: pa.Table, cells: list[Cell]) -> pa.RecordBatch:
    """Whole frames, each with its detections in turn and then its boxes by index, settled in all cells.

    Pairs that nobody else competes for are settled together. The other detections take
    their turns; what a cell has taken is a column of flags, so a turn is a few operations
    on (cells x boxes in reach) whatever the number of cells.
    """
    thr = np.array([c.iou_threshold for c in cells])
    lo, hi = (np.array([c.bounds[k] for c in cells]) for k in (0, 1))
    number = lambda name: t.column(name).to_numpy().astype(np.float64)
    is_gt, index = t.column("is_gt").to_numpy(), t.column("index").to_numpy()
    frame = np.cumsum(changes(t, FRAME)) - 1
    dets, gts = np.flatnonzero(~is_gt), np.flatnonzero(is_gt)
    boxes_of = np.bincount(frame[gts], minlength=frame[-1] + 1)
    first_box = np.cumsum(boxes_of) - boxes_of
    # Every detection with every box of its frame.
    many = boxes_of[frame[dets]]
    i = np.repeat(np.arange(len(dets)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first_box[frame[dets]], many)
    x1, y1, x2, y2 = (number(c) for c in ("x1", "y1", "x2", "y2"))
    with np.errstate(invalid="ignore", divide="ignore"):
        size = (x2 - x1) * (y2 - y1)
        p, q = dets[i], gts[j]
        inter = np.maximum(np.minimum(x2[p], x2[q]) - np.maximum(x1[p], x1[q]), 0.0) * np.maximum(np.minimum(y2[p], y2[q]) - np.maximum(y1[p], y1[q]), 0.0)
        overlap = inter / (size[p] + size[q] - inter)
        near = np.flatnonzero(overlap >= thr.min())
        i, j, overlap = i[near], j[near], overlap[near]
        px = np.sqrt(size[gts])
    inside = (px[:, None] >= lo) & (px[:, None] < hi)
    kind = np.full((len(dets), len(cells)), FALSE_POSITIVE, np.int8)
    got = np.full((len(dets), len(cells)), -1, np.int64)
    alone = (np.bincount(i, minlength=len(dets))[i] == 1) & (np.bincount(j, minlength=len(gts))[j] == 1)
    able = overlap[alone, None] >= thr
    kind[i[alone]] = np.where(able, np.where(inside[j[alone]], TRUE_POSITIVE, IGNORED), FALSE_POSITIVE)
    got[i[alone]] = np.where(able, j[alone, None], -1)
    i, j, overlap = i[~alone], j[~alone], overlap[~alone]
    free = np.ones((len(gts), len(cells)), bool)
    edges = np.flatnonzero(np.diff(i, prepend=-1, append=len(dets))) if len(i) else np.zeros(1, int)
    rows = np.arange(len(cells))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        d, near_by, over = i[a], j[a:b], overlap[a:b, None]
        able = free[near_by] & (over >= thr)
        within = able & inside[near_by]
        best = np.where(within.any(axis=0), np.where(within, over, -1.0).argmax(axis=0), np.where(able, over, -1.0).argmax(axis=0))
        won = able[best, rows]
        box = near_by[best]
        kind[d] = np.where(within[best, rows], TRUE_POSITIVE, np.where(won, IGNORED, FALSE_POSITIVE))
        got[d] = np.where(won, box, -1)
        free[box[won], rows[won]] = False
    flat = got.ravel()
    outcome = pa.StructArray.from_arrays([pa.array(kind.ravel()), pa.array(index[gts[flat]] if len(gts) else flat, mask=flat < 0)], names=["kind", "gt"])
    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(cells), dtype=np.int32)), outcome)
    take = pa.array(dets)
    return pa.RecordBatch.from_arrays([*(t.column(c).take(take).combine_chunks() for c in FRAME), pa.array(index[dets]), t.column("score").take(take).combine_chunks(), listed],
                                      names=[*FRAME, "det_index", "score", "cells"])


def _fold_frames(det: DataFrame, gt: DataFrame, cells: list[Cell]) -> DataFrame:
    """One shuffle brings both sides of a frame together; a task settles its frames as they stream by."""
    corner = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    both = det.select(*FRAME, F.lit(False).alias("is_gt"), F.col("det_index").alias("index"), *corner, F.col("score").cast("double").alias("score")).unionByName(
        gt.select(*FRAME, F.lit(True).alias("is_gt"), F.col("gt_index").alias("index"), *corner, F.lit(None).cast("double").alias("score")))
    kinds = dict(both.dtypes)
    # Within a frame detections come first, in the order of their turns: no score, then falling score, ties by index.
    turns = both.repartition(*FRAME).sortWithinPartitions(*FRAME, "is_gt", F.desc_nulls_first("score"), "index")
    return turns.mapInArrow(lambda batches: whole_frames(batches, lambda t: _settled(t, cells)), ", ".join(f"{c} {kinds[c]}" for c in FRAME) + ", det_index bigint, score double, cells array<struct<kind:tinyint,gt:bigint>>")


def _pairs_by_rounds(det: DataFrame, gt: DataFrame, cells: list[Cell]) -> DataFrame:
    """Same result as the fold for crowded frames, as rounds of joins.

    In each round a pair is final when it is the detection's best remaining choice and
    the detection comes first among all still competing for that box. The first
    detection in line always qualifies, so every round settles something.
    """
    lowest = min(c.iou_threshold for c in cells)
    pairs = box_pairs(det, gt, lowest, crowd=0)
    open_pairs = durable(
        pairs.withColumn("c", F.explode_outer(cell_array(cells))).where("iou >= c.thr")
        .select(F.col("c.cell").alias("cell"), *FRAME, "det_index", "gt_index", "score", "iou",
                ((F.col("gt_px") >= F.col("c.lo")) & (F.col("gt_px") < F.col("c.hi"))).alias("inside")))
    by_det, by_gt = ["cell", *FRAME, "det_index"], ["cell", *FRAME, "gt_index"]
    done = []
    while not open_pairs.isEmpty():
        choice = open_pairs.groupBy(*by_det).agg(
            F.max(F.struct("inside", "iou", (-F.col("gt_index")).alias("g"))).alias("m"))
        first = open_pairs.groupBy(*by_gt).agg(
            F.max(F.struct("score", (-F.col("det_index")).alias("d"))).alias("m"))
        final = durable(
            choice.select(*by_det, (-F.col("m.g")).alias("gt_index"), F.col("m.inside").alias("inside"))
            .join(first.select(*by_gt, (-F.col("m.d")).alias("det_index")), [*by_gt, "det_index"]))
        done.append(final)
        open_pairs = durable(
            open_pairs.join(final.select(*by_det), by_det, "left_anti")
            .join(final.select(*by_gt), by_gt, "left_anti"))
    schema = f"cell int, source_video {dict(det.dtypes)['source_video']}, frame_index {dict(det.dtypes)['frame_index']}," \
             " det_index bigint, gt_index bigint, kind tinyint"
    out = det.sparkSession.createDataFrame([], schema)
    for final in done:
        out = out.unionByName(final.withColumn(
            "kind", F.when(F.col("inside"), TRUE_POSITIVE).otherwise(IGNORED).cast("tinyint")).drop("inside"))
    return out


def match_outcomes(det: DataFrame, gt: DataFrame, cells: list[Cell], frame_limit: int = FRAME_LIMIT) -> DataFrame:
    """One row per detection with ``cells``, an array of struct(kind, gt) in the given order.

    Keeping the cells side by side means detections are shuffled and ranked once, not
    once per cell.
    """
    det = det.select(*FRAME, F.col("det_index").cast("long").alias("det_index"), "x1", "y1", "x2", "y2", "score")
    gt = gt.select(*FRAME, F.col("gt_index").cast("long").alias("gt_index"), "x1", "y1", "x2", "y2")
    _, crowded = split_by_size(det.select(*FRAME).unionByName(gt.select(*FRAME)), FRAME, frame_limit)
    if crowded is None:
        return _fold_frames(det, gt, cells)
    busy = durable(crowded.distinct())
    folded = _fold_frames(*(t.join(busy, FRAME, "left_anti") for t in (det, gt)), cells)
    busy_det = det.join(busy, FRAME, "left_semi")
    rounds = _pairs_by_rounds(busy_det, gt.join(busy, FRAME, "left_semi"), cells)
    per_det = rounds.groupBy(*FRAME, "det_index").agg(F.map_from_entries(F.collect_list(
        F.struct("cell", F.struct("kind", F.col("gt_index").alias("gt"))))).alias("m"))
    miss = F.struct(F.lit(FALSE_POSITIVE).cast("tinyint").alias("kind"), F.lit(None).cast("bigint").alias("gt"))
    slots = F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), miss) for i in range(len(cells))])
    return folded.unionByName(
        busy_det.select(*FRAME, "det_index", "score").join(per_det, [*FRAME, "det_index"], "left")
        .select(*FRAME, "det_index", "score", slots.alias("cells")))


def match_detections(det: DataFrame, gt: DataFrame, cells: list[Cell],
                     frame_limit: int = FRAME_LIMIT) -> DataFrame:
    """One row per (cell, detection): outcome flags and the matched ground-truth index."""
    flat = match_outcomes(det, gt, cells, frame_limit).select(
        *FRAME, "det_index", "score", F.posexplode_outer("cells").alias("cell", "o"))
    return flat.withColumn("c", F.get(cell_array(cells), F.col("cell"))).select(
        F.col("c.thr").alias("iou_threshold"), F.col("c.bucket").alias("bucket"), *FRAME, "det_index", "score",
        (F.col("o.kind") == TRUE_POSITIVE).alias("is_tp"), (F.col("o.kind") == IGNORED).alias("is_ignored"), F.col("o.gt").alias("gt_index"))
