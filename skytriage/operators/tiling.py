"""Tiles over frames, merging per-tile detections, suppression, confidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skytriage.functions.geometry import corners, field_box, iou, is_valid, named, tile_to_frame
from skytriage.operators.frames import FRAME, changes, whole_frames
from skytriage.operators.grid import home_cell, probe_cells
from skytriage.operators.scan import split_by_size
from skytriage.session import durable

#: Boxes of one frame settled inside a task; a frame with more goes through rounds.
FRAME_LIMIT = 2_000


def generate_tiles(videos: DataFrame, tile_width: int, tile_height: int, overlap: float) -> DataFrame:
    """Row-major tiles covering each frame size; the last row and column shift inward.

    ``videos`` has ``source_video, frame_width, frame_height``.
    """
    if tile_width <= 0 or tile_height <= 0 or not 0 <= overlap < 1:
        raise ValueError("tile size must be positive and overlap in [0, 1)")

    def offsets(size: Column, tile: Column) -> Column:
        last = size - tile
        step = F.greatest(F.lit(1), F.bround(tile * (1.0 - overlap)).cast("int"))
        return F.array_union(F.sequence(F.lit(0), last, step), F.array(last))

    ok = (F.col("frame_width") > 0) & (F.col("frame_height") > 0)
    size = F.when(ok, F.col("frame_width")).otherwise(F.raise_error(F.lit("frame size must be positive")).cast("int"))
    w, h = F.least(F.lit(tile_width), size), F.least(F.lit(tile_height), F.col("frame_height"))
    cut = videos.select("source_video", w.cast("int").alias("tile_w"), h.cast("int").alias("tile_h"),
                        F.col("frame_width").cast("int").alias("fw"), F.col("frame_height").cast("int").alias("fh"))
    xs, ys = offsets(F.col("fw"), F.col("tile_w")), offsets(F.col("fh"), F.col("tile_h"))
    rows = cut.select("source_video", "tile_w", "tile_h", xs.alias("xs"), F.posexplode_outer(ys).alias("row", "offset_y"))
    cells = rows.select("source_video", "tile_w", "tile_h", "row", "offset_y", F.size("xs").alias("nx"), F.posexplode_outer("xs").alias("col", "offset_x"))
    return cells.select("source_video", (F.col("row") * F.col("nx") + F.col("col")).alias("tile_index"), "offset_x", "offset_y", "tile_w", "tile_h")


def nms(det: DataFrame, iou_threshold: float, frame_limit: int = FRAME_LIMIT) -> DataFrame:
    """Detections kept by greedy suppression per frame: by falling score, ties in row order,
    a box goes when its IoU with a kept one reaches the threshold."""
    if not 0.0 < iou_threshold <= 1.0:
        raise ValueError(f"iou_threshold must be in (0, 1]; got {iou_threshold}")
    small, large = split_by_size(det, FRAME, frame_limit)
    small = small.select(*det.columns)
    # By a hash first: it tells nearly all frames apart, and the sort decides on its first key without looking at the rows.
    turns = small.repartition(*FRAME).sortWithinPartitions(F.xxhash64(*FRAME), *FRAME, (-F.col("score")).asc_nulls_first(), "det_index")
    kept = turns.mapInArrow(lambda batches: whole_frames(batches, lambda t: _kept(t, iou_threshold), nulls_equal=True), det.schema)
    return kept if large is None else kept.unionByName(_nms_rounds(large.select(*det.columns), iou_threshold))


#: Pairs of boxes whose overlap is computed together.
_PAIRS = 1 << 20


def _kept(t: pa.Table, iou_threshold: float) -> pa.RecordBatch:
    """Rows of whole frames, each in the order of its turns, that greedy suppression keeps.

    Every box meets those before it in its frame. A box that clashes with none of them is
    kept and what it clashes with goes, in as many rounds as clashes depend on each other.
    """
    starts = np.flatnonzero(changes(t, FRAME, nulls_equal=True))
    before = np.arange(t.num_rows) - np.repeat(starts, np.diff(starts, append=t.num_rows))
    corner = [t.column(c) for c in ("x1", "y1", "x2", "y2")]
    sound = np.logical_and.reduce([c.is_valid().to_numpy() for c in corner])
    x1, y1, x2, y2 = (c.to_numpy().astype(np.float64) for c in corner)
    size = (x2 - x1) * (y2 - y1)
    upto, found, a = np.cumsum(before), [np.zeros((2, 0), np.int64)], 0
    while a < t.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - before[a] + _PAIRS, "right")))
        n = before[a:b]
        q = np.repeat(np.arange(a, b), n)
        p = np.arange(len(q)) - np.repeat(np.cumsum(n) - n - np.arange(a, b) + n, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            inter = np.maximum(np.minimum(x2[p], x2[q]) - np.maximum(x1[p], x1[q]), 0.0) * np.maximum(np.minimum(y2[p], y2[q]) - np.maximum(y1[p], y1[q]), 0.0)
            union = size[p] + size[q] - inter
            # As in SQL a value that is not a number is above any threshold, and null is not.
            clash = sound[p] & sound[q] & (union != 0) & ~(inter / union < iou_threshold)
        found.append(np.stack([p[clash], q[clash]]))
        a = b
    p, q = np.concatenate(found, axis=1)
    gone, barred = np.zeros(t.num_rows, bool), np.zeros(t.num_rows, bool)
    while len(p):
        barred[q] = True
        gone[q[~barred[p]]] = True
        barred[q] = False
        left = ~gone[p] & ~gone[q]
        p, q = p[left], q[left]
    return t.filter(pa.array(~gone)).combine_chunks().to_batches()[0]


def _nms_rounds(det: DataFrame, iou_threshold: float) -> DataFrame:
    """The same for crowded frames, without listing overlapping pairs.

    A box that comes first among all undecided boxes of the cells it could clash with is
    kept; kept boxes then remove what they overlap. Cells are compared through their one
    best box, so a dense spot costs its number of boxes, not its square.
    """
    order = F.struct(F.col("score"), (-F.col("det_index")).alias("tie"))
    left = durable(det.withColumns({"_rank": order, "_cell": home_cell(corners())}))
    done = []
    while not left.isEmpty():
        best = left.groupBy(*FRAME, "_cell").agg(F.max("_rank").alias("_top"))
        around = left.select(*FRAME, "det_index", "_rank", F.explode_outer(probe_cells(corners(), iou_threshold)).alias("_cell"))
        first = around.join(best, [*FRAME, "_cell"]).groupBy(*FRAME, "det_index").agg(
            F.max("_top").alias("_top"), F.first("_rank").alias("_own")).where("_top = _own").select(*FRAME, "det_index")
        won = durable(left.join(first, [*FRAME, "det_index"], "left_semi"))
        done.append(won)
        reach = won.select(*FRAME, F.struct("x1", "y1", "x2", "y2").alias("_w"), F.explode_outer(probe_cells(corners(), iou_threshold)).alias("_cell"))
        hit = left.join(reach, [*FRAME, "_cell"]).where(iou(field_box(F.col("_w")), corners()) >= iou_threshold)
        gone = hit.select(*FRAME, "det_index").unionByName(won.select(*FRAME, "det_index")).distinct()
        left = durable(left.join(gone, [*FRAME, "det_index"], "left_anti"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*det.columns)


def merge_tiles(det: DataFrame, tiles: DataFrame, iou_threshold: float = 0.5, frame_limit: int = FRAME_LIMIT) -> DataFrame:
    """Per-tile detections in frame coordinates with duplicates across tiles suppressed.

    ``det`` has ``source_video, frame_index, tile_index, det_index`` (unique in a frame).
    """
    keys = ["source_video", "tile_index"]
    moved = det.join(tiles.select(*keys, "offset_x", "offset_y"), keys)
    rest = [c for c in det.columns if c not in ("x1", "y1", "x2", "y2")]
    shifted = moved.select(*rest, *named(tile_to_frame(corners(), F.col("offset_x"), F.col("offset_y"))))
    return nms(shifted, iou_threshold, frame_limit)


def drop_degenerate(det: DataFrame, operating_threshold: float) -> tuple[DataFrame, DataFrame]:
    """(detections with extent, one row: how many were dropped and the highest score lost)."""
    ok = is_valid(corners())
    stats = det.agg(
        F.count("*").alias("n_detections"), F.count_if(~ok).alias("n_dropped"), F.max(F.when(~ok, F.col("score"))).alias("max_dropped_score"))
    return det.where(ok), stats.withColumn(
        "affects_operating_point", F.coalesce(F.col("max_dropped_score") >= operating_threshold, F.lit(False)))


def filter_confidence(det: DataFrame, threshold: float) -> DataFrame:
    """Detections at or above the threshold; for counts at an operating point, never for AP."""
    return det.where(F.col("score") >= threshold)


def detection_funnel(det: DataFrame, tracks: DataFrame, videos: DataFrame, high: float = 0.5, low: float = 0.1) -> DataFrame:
    """Per video: detections, how many reach each tracking threshold, best score, tracks."""
    d = det.groupBy("source_video").agg(
        F.count("*").alias("n_detections"), F.count_if(F.col("score") >= high).alias("n_high"),
        F.count_if(F.col("score") >= low).alias("n_low"), F.max("score").alias("best_score"))
    t = tracks.groupBy("source_video").agg(F.count("*").alias("n_tracks"))
    out = videos.select("source_video").join(d, "source_video", "left").join(t, "source_video", "left").fillna(
        0, ["n_detections", "n_high", "n_low", "n_tracks"])
    return out.withColumn("no_tracks_from_detections", (F.col("n_detections") > 0) & (F.col("n_tracks") == 0))
